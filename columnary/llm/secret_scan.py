"""Secret scan with multipart linking: DataFrame functions only.

Strong finds stand alone: assigned secrets, access ids and long hex runs. Weak
candidates (account names, bare 40-character keys, short assigned secrets,
endpoints) are reported only beside their complement: identifiers beside a
secret, weak secrets beside an identifier, endpoints beside both, with starts at
most ``SCOPE`` code points apart in one text. With ``any_two`` (the query and the
pipeline) two different ones of secret, identifier and endpoint are enough.

Linking is an interval join: parts are put in cells of one scope length, each
cell keeps the first and last start of every role (so nothing grows with the
number of parts in a cell), and a candidate meets its own and the two
neighbouring cells. Texts are joined by digest, so copies are linked once.

Positions are code points, ends exclusive. Defined cases: null or empty text has
no spans; equal rows are kept each; a null id is kept; an empty table gives an
empty one; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SCOPE = 300
_SEP = r"""["']?\x20*[:=]\x20*["']?"""
ASSIGN = r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])" + _SEP + r"([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENT = r"(?i)\b(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|access_?key_?id)" + _SEP + r"[A-Za-z0-9@._-]{3,}"
KEY = r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]{0,39}[A-Z])(?=[A-Za-z0-9+/]{0,39}[a-z])(?=[A-Za-z0-9+/]{0,39}[0-9])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])"
ENDPOINT = r"[a-z][a-z0-9+.-]{1,15}://[^\s\"'<>]{4,}|\b(?:[A-Za-z0-9-]+\.)+[a-z]{2,}:[0-9]{2,5}\b"
#: Kinds in the order that settles equal starts.
KINDS = ("assign", "access", "hex", "ident", "key", "short", "endpoint")
_ROLE = {"assign": "secret", "short": "secret", "key": "secret", "hex": "secret", "access": "identifier", "ident": "identifier", "endpoint": "endpoint"}
_NONE = "array<struct<start:int,end:int,value:int>>"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches in order: array of (start, end, value), value the length of ``group``.

    The pieces between matches and the matches themselves take turns, so their
    lengths add up to the positions.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else hits
    steps = F.zip_with(F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda g, h: F.struct(F.char_length(g).alias("gap"), F.char_length(h).alias("hit"))),
                       values, lambda s, v: F.struct(s["gap"].alias("gap"), s["hit"].alias("hit"), F.char_length(v).alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_NONE).alias("out"))
    walked = F.aggregate(steps, start, lambda a, s: F.struct(
        (a["at"] + s["gap"] + s["hit"]).alias("at"),
        F.array_append(a["out"], F.struct((a["at"] + s["gap"]).alias("start"), (a["at"] + s["gap"] + s["hit"]).alias("end"), s["value"].alias("value"))).alias("out"),
    ))
    return F.when(text.rlike(pattern), walked["out"]).otherwise(F.array().cast(_NONE))


def _as(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``secret_key, secret_base, secret_weak``: spans as arrays of
    (start, rank, end, kind), and the text's digest where it has weak candidates."""
    own = docs.select(*docs.columns, F.coalesce(F.col(text), F.lit("")).alias("secret_text"))
    said = F.col("secret_text")
    found = own.select("*", _matches(said, ASSIGN, 2).alias("assigned_"), *(_matches(said, p).alias(n) for n, p in (
        ("access_", ACCESS), ("hex_", HEX), ("ident_", IDENT), ("key_", KEY), ("endpoint_", ENDPOINT))))
    strong = F.concat(_as(F.filter("assigned_", lambda s: s["value"] >= 6), "assign"), _as(F.col("access_"), "access"), _as(F.col("hex_"), "hex"))
    loose = F.concat(_as(F.col("ident_"), "ident"), _as(F.col("key_"), "key"), _as(F.filter("assigned_", lambda s: s["value"] < 6), "short"), _as(F.col("endpoint_"), "endpoint"))
    based = found.select(*docs.columns, "secret_text", F.array_sort(strong).alias("secret_base"), loose.alias("loose_"))
    # a candidate inside a strong find adds nothing
    weak = F.filter("loose_", lambda w: ~F.exists("secret_base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    judged = based.select(*docs.columns, "secret_text", "secret_base", weak.alias("secret_weak"))
    return judged.select(*docs.columns, F.when(F.size("secret_weak") > 0, F.sha2("secret_text", 256)).alias("secret_key"), "secret_base", "secret_weak")


def linked(found: DataFrame, any_two: bool = False) -> DataFrame:
    """``secret_key, extra``: the weak spans of each text that have their complement in scope."""
    sides = ("secret", "identifier", "endpoint") if any_two else ("secret", "identifier")
    texts = found.where("secret_key is not null").groupBy("secret_key").agg(F.first("secret_base").alias("base"), F.first("secret_weak").alias("weak"))
    role = F.create_map(*[F.lit(x) for pair in _ROLE.items() for x in pair])
    cell = F.floor(F.col("s.start") / SCOPE).alias("cell")
    parts = texts.select("secret_key", F.explode(F.concat("base", "weak")).alias("s")).select("secret_key", cell, role[F.col("s.kind")].alias("role"), F.col("s.start").alias("start")).where(F.col("role").isin(*sides))
    cells = parts.groupBy("secret_key", "cell", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = texts.select("secret_key", F.explode("weak").alias("s")).select("secret_key", "s", role[F.col("s.kind")].alias("own"), F.explode(F.array(*[(F.floor(F.col("s.start") / SCOPE) + d) for d in (-1, 0, 1)])).alias("cell"))
    near = (F.col("first") <= F.col("s.start") + SCOPE) & (F.col("last") >= F.col("s.start") - SCOPE) & (F.col("role") != F.col("own"))
    met = weak.join(cells, ["secret_key", "cell"]).where(near).groupBy("secret_key", "s", "own").agg(F.count_distinct("role").alias("roles"))
    enough = met.where(F.col("roles") >= F.when((F.col("own") == "endpoint") & F.lit(not any_two), 2).otherwise(1))
    return enough.groupBy("secret_key").agg(F.collect_list("s").alias("extra"))


def _with_spans(found: DataFrame, any_two: bool) -> DataFrame:
    """``found`` (see ``candidates``, written) with ``secret_spans``: strong and linked weak spans.

    Only rows with weak candidates are joined; the others keep their place.
    """
    plain = found.where("secret_key is null").withColumn("secret_spans", F.col("secret_base"))
    extra = linked(found, any_two).withColumnRenamed("secret_key", "extra_key")
    none = F.array().cast(found.schema["secret_weak"].dataType)
    joined = found.where("secret_key is not null").join(extra, F.col("secret_key") == F.col("extra_key"), "left")
    both = joined.withColumn("secret_spans", F.array_sort(F.concat("secret_base", F.coalesce("extra", none)))).select(*plain.columns)
    return plain.unionByName(both)


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", any_two: bool = False) -> DataFrame:
    """Per row ``doc_id, base, spans``: strong spans, and those with the linked weak ones, by start and kind."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = cut(candidates(own).drop("text"), "secret-candidates")
    return _with_spans(found, any_two).select("doc_id", F.col("secret_base").alias("base"), F.col("secret_spans").alias("spans"))


def redacted(docs: DataFrame, text: str = "text", mask: str = "[secret]", any_two: bool = False) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by ``mask``; null texts stay null."""
    found = _with_spans(cut(candidates(docs, text), "secret-rows"), any_two)
    body, spans = F.col(text), F.col("secret_spans")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    # spans inside what is already masked lengthen the mask
    walked = F.aggregate(spans, start, lambda a, s: F.struct(
        F.greatest(a["at"], s["end"]).alias("at"),
        F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(F.substr(body, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)))).alias("out"),
    ))
    masked = F.concat(F.array_join(walked["out"], ""), F.substr(body, walked["at"] + 1))
    return found.withColumn(text, F.when(F.size(spans) > 0, masked).otherwise(body)).select(*docs.columns)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
