"""Query, change and model operators on top of the plans."""
