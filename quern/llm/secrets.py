"""Secret scan with multipart credential linking, in DataFrame functions only.

Method
    Every whole text is marked up once per pattern by ``regexp_replace`` and split at the marks,
    which gives each match's place in code points. Strong patterns (``assign``, ``access``,
    ``hex``) are reported as they are. Weak candidates are parts of a credential: identifiers,
    secrets and endpoints. A part's scope is the interval of ``SCOPE`` code points around it. An
    interval join within each text - a sweep over parts by start, keeping the furthest end before
    and the nearest start after for each role, so that it stays linear - finds which roles meet in
    a scope. A weak secret is reported if an identifier is in its scope, a weak identifier if a
    secret is, an endpoint if both are. Strong spans are parts, too; a weak candidate that overlaps
    a strong span is not reported.

Defined results: a null text is an empty one; a null id is carried along; every row is scanned on
its own, so repeated rows give repeated results; an empty table gives no rows; other columns are
ignored by ``scan`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, read_table, texts_of

#: Code points around a part within which its complements are looked for.
SCOPE = 200

_SET = "[\"']?\\x20*[:=]\\x20*[\"']?"


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches are kept if ``group`` has a length from ``least`` to ``most`` and, if
    ``mixed``, a digit and letters of both cases in it, or a digit alone if ``digit``."""

    name: str
    role: str
    pattern: str
    group: int
    least: int
    most: int = 1 << 30
    mixed: bool = False
    digit: bool = False
    strong: bool = False


# Strong kinds in the order of the contract, then weak ones.
KINDS = (
    Kind("assign", "secret", f"((?i:password|passwd|secret|token|api_?key)){_SET}([A-Za-z0-9+/_.=-]+)", 2, 6, strong=True),
    Kind("access", "id", "AKIA[A-Z0-9]+", 0, 20, strong=True),
    Kind("hex", "secret", "[0-9a-f]{24,}", 0, 24, strong=True),
    Kind("key_part", "id", "AKIA[A-Z0-9]+", 0, 12, 19),
    Kind("id_part", "id", f"(?i:user(?:name)?|login|account(?:_?id)?|client_?id|access_?key(?:_?id)?){_SET}([A-Za-z0-9._@-]+)", 1, 3),
    Kind("hex_part", "secret", "[0-9a-f]{16,}", 0, 16, 23, digit=True),
    Kind("secret_part", "secret", f"(?i:pwd|pass(?:phrase)?|private_?key|auth(?:orization)?|credential){_SET}([A-Za-z0-9+/_.=-]+)", 1, 6),
    Kind("run_part", "secret", "[A-Za-z0-9+/_-]{28,}={0,2}", 0, 28, mixed=True),
    Kind("url_part", "endpoint", "(?:https?|ftps?|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?|s3)://[A-Za-z0-9._~:@/?&%=+-]+", 0, 8),
    Kind("host_part", "endpoint", f"(?i:host|endpoint|server){_SET}([A-Za-z0-9.-]+)", 1, 4),
)
RANK = {kind.name: i for i, kind in enumerate(KINDS)}
ROLES = ("id", "secret", "endpoint")

_SPANS = "array<struct<start:int,rank:int,end:int>>"


def _spans(text: Column, kind: Kind) -> Column:
    """The kept matches of one kind in ``text``, as an array of (start, rank, end)."""
    # U+0001 and U+0002 mark places; no pattern can match them, so in the text they are replaced.
    clean = F.translate(text, "\x01\x02", "\x03\x03")
    marked = F.regexp_replace(clean, kind.pattern, f"\x01$0\x02${kind.group}\x01")
    parts = F.split(marked, "\x01")
    shown = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.substring_index(p, "\x02", 1)).otherwise(p))
    tested = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.substring_index(p, "\x02", -1)))

    def step(acc: Column, part: Column) -> Column:
        """part: length of what stands in the text, and whether it is a kept match."""
        end = acc["at"] + part["length"]
        new = F.when(part["kept"], F.concat(acc["spans"], F.array(
            F.struct(acc["at"].alias("start"), F.lit(RANK[kind.name]).alias("rank"), end.alias("end"))))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), new.alias("spans"))

    def kept(t: Column) -> Column:
        ok = t.isNotNull() & F.length(t).between(kind.least, kind.most)
        if kind.mixed:
            ok = ok & t.rlike("[0-9]") & t.rlike("[a-z]") & t.rlike("[A-Z]")
        if kind.digit:
            ok = ok & t.rlike("[0-9]")
        return F.coalesce(ok, F.lit(False))

    measured = F.zip_with(shown, tested, lambda s, t: F.struct(F.length(s).alias("length"), kept(t).alias("kept")))
    start = F.struct(F.lit(0).alias("at"), F.from_json(F.lit("[]"), _SPANS).alias("spans"))
    found = F.aggregate(measured, start, step, lambda acc: acc["spans"])
    return F.when(text.rlike(kind.pattern), found).otherwise(F.from_json(F.lit("[]"), _SPANS))


def _candidates(df: DataFrame, text: Column, keep: list) -> DataFrame:
    """The columns to ``keep``, a row number, and each text's strong spans and weak parts, in the
    shared folder."""
    strong = [k for k in KINDS if k.strong]
    weak = [k for k in KINDS if not k.strong]
    return materialise(df.select(
        *keep, F.monotonically_increasing_id().alias("row_id"),
        F.array_sort(F.concat(*(_spans(text, k) for k in strong))).alias("strong"),
        F.concat(*(_spans(text, k) for k in weak)).alias("weak")), "secrets")


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """row_id and its weak spans that have their complements in scope."""
    role = F.element_at(F.create_map(*(F.lit(x) for k in KINDS for x in (RANK[k.name], k.role))), F.col("rank"))
    strong_ranks = [RANK[k.name] for k in KINDS if k.strong]
    parts = found.where(F.size("weak") > 0).select("row_id", F.inline(F.concat("strong", "weak")))
    parts = parts.withColumn("role", role).withColumn("is_strong", F.col("rank").isin(strong_ranks))
    # Both ways are growing frames: one that shrinks would be summed up anew for every row.
    keys, earlier = ("start", "end", "rank"), (Window.unboundedPreceding, -1)
    before = Window.partitionBy("row_id").orderBy(*keys).rowsBetween(*earlier)
    after = Window.partitionBy("row_id").orderBy(*map(F.desc, keys)).rowsBetween(*earlier)

    def meets(which: Column, margin: int) -> Column:
        """Whether a part of ``which`` comes within ``margin`` of this one."""
        left = F.max(F.when(which, F.col("end"))).over(before) + margin > F.col("start")
        right = F.min(F.when(which, F.col("start"))).over(after) - margin < F.col("end")
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    near = {r: meets(F.col("role") == r, scope) for r in ROLES}
    wanted = (
        F.when(F.col("role") == "secret", near["id"]).when(F.col("role") == "id", near["secret"]).otherwise(near["id"] & near["secret"])
    )
    swept = parts.select("row_id", "start", "rank", "end", "is_strong", wanted.alias("linked"), meets(F.col("is_strong"), 0).alias("covered"))
    kept = swept.where("linked and not covered and not is_strong")
    return kept.groupBy("row_id").agg(F.collect_list(F.struct("start", "rank", "end")).alias("linked"))


def _joined(spans: Column) -> Column:
    """Spans as kind:start:end, by start, then kind, joined by commas."""
    name = F.create_map(*(F.lit(x) for k in KINDS for x in (RANK[k.name], k.name)))
    shown = F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(name, s["rank"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(shown, ",")


def _with_links(found: DataFrame, scope: int) -> DataFrame:
    return found.join(_linked(found, scope), "row_id", "left").withColumn("linked", F.coalesce("linked", F.from_json(F.lit("[]"), _SPANS)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, counts of strong spans, the digest of the strong spans, and all spans."""
    found = _candidates(texts_of(df, id_col, text_col), F.col("text"), ["doc_id"])
    count = lambda name: F.size(F.filter("strong", lambda s: s["rank"] == RANK[name])).cast("long").alias(f"n_{name}")
    return _with_links(found, scope).select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("strong")), 256).alias("base_sha256"),
        _joined(F.concat("strong", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))


def redact(df: DataFrame, text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """``df`` with every reported span of its text replaced by [kind]; null texts stay null."""
    text = F.col(f"`{text_col}`")
    found = _candidates(df, F.coalesce(text, F.lit("")), [F.struct("*").alias("row")])
    own = F.col(f"row.`{text_col}`")
    name = F.create_map(*(F.lit(x) for k in KINDS for x in (RANK[k.name], k.name)))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(acc["out"], F.substring(own, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.element_at(name, s["rank"]), F.lit("]"))
        inside = s["start"] < acc["at"]  # overlaps the span before: only its rest is left out
        return F.struct(F.when(inside, acc["out"]).otherwise(mark).alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    finish = lambda acc: F.concat(acc["out"], F.substring(own, acc["at"] + 1, F.length(own)))
    clean = F.aggregate(F.array_sort(F.concat("strong", "linked")), F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, finish)
    touched = (F.size("strong") > 0) | (F.size("weak") > 0)
    changed = _with_links(found.where(touched), scope).select("row", clean.alias("clean"))
    same = found.where(~touched).select("row", own.alias("clean"))
    columns = [(F.col("clean") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns]
    return changed.union(same).select(*columns)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))


QUERIES = {"op2_secret_scan": op2_secret_scan}
ORACLE_SQL: dict[str, str] = {}
