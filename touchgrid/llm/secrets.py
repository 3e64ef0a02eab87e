"""Secret scans in DataFrame functions alone (no Python on the executors).

Base findings per kind are the leftmost non-overlapping matches of a pattern.
``split`` gives the text between them and ``regexp_extract_all`` the matches;
their lengths add up to code-point offsets, in chunks of matches, so that cost
is linear in them.  No pattern repeats a group, which the regex engine would do
by recursion, and each begins only where a run of its characters does.

Multipart linking: a bare 40-character key and an endpoint address are weak
candidates.  They count only where complementary parts co-occur: within
``SCOPE`` characters of an access identifier (a key), or of an access
identifier and, as well, of a secret (an endpoint).  The interval join is a
semi join on (document, bin of ``SCOPE`` characters) with the range as its
condition; a bin holds few identifiers, as each is at least 20 characters long,
so no pair is emitted and no group grows.

Nulls: a null text is an empty one (no spans); null doc_ids stay null.  Rows
equal in doc_id and text get equal results.  Texts of any length are scanned
whole.  Spans that begin at one place are listed by kind; equal spans of a text
are one.  An empty table gives no row.  Only doc_id and text are read: other
columns, whatever their names, are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .shared import written

SCOPE = 400
#: The patterns of the base kinds, in the order of their listing, and of the weak parts.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KEY = "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])"
URL = r"""https?://[^\x09-\x0D\x20"'<>]+"""
HOST = r"(?<![a-z0-9.-])[a-z0-9.-]*(?<=[a-z0-9-]\.amazonaws\.com)"
ENDPOINT = f"(?:{URL}|{HOST})"
KINDS = ("assign", "access", "hex", "key", "endpoint")

_CHUNK = 128
_SPANS = "array<struct<start:int,kind:int,end:int,text:string>>"


def _spans(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<start, kind, end, text>> of all matches, by start."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    none = F.from_json(F.lit("[]"), _SPANS)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["text"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), x["text"].alias("text")))).cast(_SPANS).alias("out"))

    def shifted(chunk, base):
        return F.transform(chunk["out"], lambda x: F.struct((x["start"] + base).alias("start"), x["kind"].alias("kind"), (x["end"] + base).alias("end"), x["text"].alias("text")))

    zipped = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("text")))

    def placed(pairs):
        # an array grows by a copy, so it grows to a chunk only, and chunks move to their place
        numbers = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int"))
        chunks = F.transform(numbers, lambda c: F.aggregate(F.slice(pairs, c * _CHUNK + 1, _CHUNK), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
        return _let(chunks, lambda cs: F.flatten(F.zip_with(cs, F.aggregate(F.transform(cs, lambda c: c["at"]), F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)), lambda acc: F.slice(acc, 1, F.size(acc) - 1)), shifted)))

    return F.when(text.rlike(pattern), _let(zipped, placed)).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: lambdas compute what they name for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat(names[s["kind"]], F.lit(":"), s["start"], F.lit(":"), s["end"])), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Findings of each of ``docs(doc_id, text)``: counts, base digest and all spans."""
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = base.select("doc_id", "text", _spans(F.col("text"), ASSIGN, 0).alias("assign"), F.when(F.contains("text", F.lit("AKIA")), _spans(F.col("text"), ACCESS, 1)).otherwise(F.from_json(F.lit("[]"), _SPANS)).alias("access"), _spans(F.col("text"), HEX, 2).alias("hex"))
    base = base.withColumn("assign", F.filter("assign", lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6))
    part = F.size("access") > 0
    none = F.from_json(F.lit("[]"), _SPANS)
    base = base.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), "assign", "access", "hex",
        F.when(part, _spans(F.col("text"), KEY, 3)).otherwise(none).alias("keys"),
        F.when(part, _spans(F.col("text"), ENDPOINT, 4)).otherwise(none).alias("endpoints"),
    )
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = written(base.select("doc_id", "text_hash", *(bare(c).alias(c) for c in ("assign", "access", "hex", "keys", "endpoints"))), "secrets")

    spans = F.concat("assign", "access", "hex")
    weak = base.filter((F.size("access") > 0) & (F.size("keys") + F.size("endpoints") > 0))

    def parts(*cols):
        return weak.select("doc_id", "text_hash", F.explode(F.concat(*cols)).alias("s")).select("doc_id", "text_hash", "s", F.col("s.start").alias("a"), F.col("s.end").alias("b")).distinct()

    def near(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows of ``left`` that start within SCOPE characters of a row of ``right`` in the same document."""
        l, r = left.withColumn("bin", F.expr(f"a div {SCOPE}")).alias("l"), right.withColumn("bin", F.explode(F.expr(f"sequence(greatest(0, a - {SCOPE}) div {SCOPE}, (b + {SCOPE}) div {SCOPE})"))).alias("r")
        same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")) & (F.col("l.bin") == F.col("r.bin"))
        return l.join(r, same & (F.col("l.a") >= F.col("r.a") - SCOPE) & (F.col("l.a") <= F.col("r.b") + SCOPE), "left_semi").drop("bin")

    access = parts("access")
    keys = near(parts("keys"), access)
    secrets = keys.unionByName(parts("assign"))
    endpoints = near(near(parts("endpoints"), access), secrets)
    linked = keys.unionByName(endpoints).groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("linked"))
    linked = linked.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_hash"), "linked")
    out = base.join(linked, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_hash") == F.col("of_hash")), "left")
    empty = F.from_json(F.lit("[]"), "array<struct<start:int,kind:int,end:int>>")
    whole = F.concat(spans, F.coalesce("linked", empty))
    return out.select(
        "doc_id",
        *(F.size(c).cast("long").alias(f"n_{c}") for c in ("assign", "access", "hex")),
        F.sha2(_joined(spans), 256).alias("base_sha256"),
        _joined(whole).alias("spans"),
        F.size(F.coalesce("linked", empty)).cast("long").alias("n_linked"),
    )
