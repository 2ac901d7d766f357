"""Secret scans with multipart credential linking, in DataFrame functions alone.

Strong patterns (assignments, access identifiers, long hex runs) are reported wherever they stand.
Weak candidates (identifier-like and key-like tokens, endpoints) are common in clean text, so they are
reported only beside complementary parts: identifiers and endpoints beside a secret (key, assignment or
hex run), keys beside an identifier or endpoint. Scopes are paragraphs; within a scope an interval join by
window functions looks up the nearest complementary part on either side of every candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.llm.components import checkpointed, row_reference

# The strong patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "ident", "key", "endpoint")
SECRETS = ("key", "assign", "hex")
LEAST_VALUE = 6

# Weak patterns. A token is a whole run; what it may be is told by its length and letters.
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
TOKEN_32 = r"[A-Za-z0-9+/_-]{32}"
IDENT = r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]{16,32}$"
KEY = r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/_-]{32,64}$"
ENDPOINT = r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?[^\x20\x09-\x0D\"'<>]*"
BREAK = r"\n[\x20\x09]*\n"
REACH = 400
RUN = 256
SPANS = "array<struct<kind:string,start:int,end:int>>"


def _before(lengths: Column) -> Column:
    """Sum of the entries before each entry, in runs, so that long arrays cost little more than their length."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / RUN).cast("int")), lambda i: F.slice(lengths, i * RUN + 1, RUN))

    def sums(values: Column, start: Column) -> Column:
        last = lambda a: F.element_at(a, -1)
        return F.aggregate(values, F.array(start), lambda a, v: F.concat(a, F.array(last(a) + v)))

    def from_runs(r: Column) -> Column:
        totals = F.transform(r, lambda x: F.aggregate(x, F.lit(0), lambda a, v: a + v))
        starts = sums(totals, F.lit(0))
        return F.flatten(F.zip_with(r, F.slice(starts, 1, F.size(r)), lambda x, s: F.slice(sums(x, s), 1, F.size(x))))

    # binds the runs once
    return F.element_at(F.transform(F.array(runs), from_runs), 1)


def _found(text: Column, pattern: str, kind: str) -> Column:
    """Spans of all matches: lengths of the gaps and matches before a match give its start."""
    none = F.array().cast("array<struct<kind:string,start:int,end:int,word:string>>")

    def placed(words: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(words))
        sizes = F.zip_with(gaps, words, lambda g, w: F.length(g) + F.length(w))
        return F.zip_with(
            F.zip_with(_before(sizes), gaps, lambda b, g: b + F.length(g)), words,
            lambda start, w: F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(w)).alias("end"), w.alias("word")))

    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    bound = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, placed(w)).otherwise(none))
    return F.element_at(bound, 1)


def _bare(spans: Column, kind: str | None = None) -> Column:
    name = lambda s: F.lit(kind) if kind else s["kind"]
    return F.transform(spans, lambda s: F.struct(name(s).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _listed(spans: Column) -> Column:
    """Spans by start, then in the order of KINDS, then by end."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def shown(spans: Column) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _linked(cases: DataFrame, reach: int) -> DataFrame:
    """``row``, ``weak``: candidates with the parts they need within ``reach`` code points of the same scope."""
    events = cases.select("row", F.explode("events").alias("e")).select("row", "e.*")
    scope = F.sum(F.when(F.col("kind") == "break", 1).otherwise(0)).over(
        Window.partitionBy("row").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, 0))
    events = events.withColumn("scope", scope)
    line = Window.partitionBy("row", "scope").orderBy("start", "end", "kind")
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    # later parts are met in reverse: a frame that runs on to the end is summed anew for every row
    back = Window.partitionBy("row", "scope").orderBy(F.desc("start"), F.desc("end"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)

    def near(*kinds: str) -> Column:
        part = F.col("kind").isin(*kinds)
        left = F.col("start") - F.max(F.when(part, F.col("end"))).over(earlier) <= reach
        right = F.min(F.when(part, F.col("start"))).over(back) - F.col("end") <= reach
        return F.coalesce(left, F.lit(False)) | F.coalesce(right, F.lit(False))

    flags = events.withColumns({"by_id": near("ident", "access"), "by_secret": near(*SECRETS), "by_end": near("endpoint")})
    kept = flags.where(
        ((F.col("kind") == "ident") & F.col("by_secret")) | ((F.col("kind") == "key") & (F.col("by_id") | F.col("by_end")))
        | ((F.col("kind") == "endpoint") & F.col("by_secret")))
    return kept.groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("weak"))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``id_col``, n_assign, n_access, n_hex, base_spans, spans (arrays of kind, start, end in code points).

    base_spans holds the strong ones; spans adds linked weak candidates. Null is the empty text, without
    spans. Spans of different kinds may overlap. Repeated rows and null ids keep a row each; extra columns
    are ignored. The result is cut from its lineage.
    """
    return _scanned(docs, id_col, text_col, reach).select(F.col("id").alias(id_col), *[f"n_{k}" for k in KINDS[:3]], "base_spans", "spans")


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with every span that ``scan_secrets`` reports replaced by a mark; columns stay as they are.

    Only rows with a possible span are scanned for places and moved to meet them.
    """
    possible = F.col(text_col).rlike(f"(?:{ASSIGN})|{ACCESS}|{HEX}|{TOKEN_32}")
    may = F.coalesce(possible, F.lit(False))
    marked = docs.where(may).withColumn("__ref", row_reference(F.col(id_col), F.col(text_col)))
    spans = _scanned(docs.where(may), id_col, text_col, reach).where(F.size("spans") > 0)
    spans = spans.select(F.col("id").alias("__id"), F.col("ref").alias("__r"), F.col("spans").alias("__spans")).dropDuplicates(["__r", "__id"])
    joined = marked.join(spans, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__ref") == F.col("__r")), "left")
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col("__spans")))
    return docs.where(~may).unionByName(joined.withColumn(text_col, clean).select(*docs.columns))


def _scanned(docs: DataFrame, id_col: str, text_col: str, reach: int) -> DataFrame:
    """``scan_secrets`` with the rows' references."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    raw = docs.select(F.col(id_col).alias("id"), text.alias("text"), row_reference(F.col(id_col), F.col(text_col)).alias("ref"))
    values = F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2))
    assign = F.zip_with(_found(F.col("text"), ASSIGN, "assign"), values, lambda s, v: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), v.alias("word")))
    assign = F.filter(assign, lambda s: F.length(s["word"]) >= LEAST_VALUE)
    tokens = _found(F.col("text"), TOKEN, "token")
    strong = raw.select("id", "ref", "text", _bare(assign).alias("assign"), _bare(_found(F.col("text"), ACCESS, "access")).alias("access"),
                        _bare(_found(F.col("text"), HEX, "hex")).alias("hex"),
                        F.filter(tokens, lambda s: s["word"].rlike("[0-9]")).alias("tokens"))
    weak = strong.select(
        "id", "ref", "text", "assign", "access", "hex",
        _bare(F.filter("tokens", lambda s: s["word"].rlike(IDENT) & ~s["word"].startswith("AKIA")), "ident").alias("ident"),
        _bare(F.filter("tokens", lambda s: s["word"].rlike(KEY)), "key").alias("key"))
    some = F.size("key") + F.size("assign") + F.size("hex") > 0  # every link has a secret
    none = F.array().cast(SPANS)
    found = weak.select(
        "id", "ref", "assign", "access", "hex", "ident", "key",
        F.when(some, _bare(_found(F.col("text"), ENDPOINT, "endpoint"))).otherwise(none).alias("endpoint"),
        F.when(some, _bare(_found(F.col("text"), BREAK, "break"))).otherwise(none).alias("breaks"))
    found = checkpointed(found.withColumn("row", F.monotonically_increasing_id()))
    events = F.concat("assign", "access", "hex", "ident", "key", "endpoint", "breaks")
    cases = found.where((F.size("key") + F.size("assign") + F.size("hex") > 0) & (F.size("access") + F.size("ident") + F.size("endpoint") > 0)).select("row", events.alias("events"))
    both = found.join(_linked(cases, reach), "row", "left")
    base = F.concat("assign", "access", "hex")
    return both.select(
        "id", "ref", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]],
        _listed(base).alias("base_spans"), _listed(F.concat(base, F.coalesce("weak", none))).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with its spans (by start) replaced; overlapping spans give one mark."""
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, s: Column) -> Column:
        fresh = F.when(s["start"] >= a["at"], F.concat(F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise("")
        return F.struct(F.concat(a["out"], fresh).alias("out"), F.greatest(a["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
