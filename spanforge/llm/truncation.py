"""Texts cut off by field limits.

The text itself shows a cut by its last trigram. Word trigrams (digits made
alike, punctuation a word of its own) are counted inside texts, where something
follows, and at ends. The last trigram of each text is joined to these counts,
its last word also as the beginning of a longer one, and a text is flagged if
its ending is frequent inside but almost never at an end: if the upper bound of
the share of ends among its occurrences (Wilson's, two standard errors) is at
most ``MOST_TERMINAL``. The bound asks for more occurrences where there are few
and tends to the share itself where there are many, so the rule is the same at
every size of the corpus. All of it is SQL.

Other evidence about the same record is exact and joined by its id: a captured
chunk of the request that is flagged as truncated or was copied shorter than it
was; a content-length beyond the bytes that are there; a JSON or XML document
that is not closed. A content-length that is met, or a JSON or XML document
that is closed, shows that the text is whole and overrules the trigram.

Defined results: null texts are no cases; an empty text is whole unless a chunk
or a content-length says otherwise; unknown lengths (0 or null) are no evidence;
repeated rows of a record give one case; records without id are left out; empty
tables give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanforge.session import stored

#: A last trigram is flagged if it ends a text at most in this share of its occurrences, at a confidence of so many standard errors.
MOST_TERMINAL, ERRORS = 0.05, 2.0
WORD = r"[\p{L}\p{M}]+|\p{N}+(?:[-./: ]\p{N}+)*|[^\p{L}\p{M}\p{N}\s]"
START = "^"
#: Flagged endings are broadcast up to so many bytes; above it the join is shuffled.
BROADCAST_BYTES = 16 << 20
STOPS = (".", "!", "?", "。")


def plain(body: Column, form: Column) -> Column:
    """The text as it reads: form encoding undone, digits alike, an ellipsis or replacement characters at the end removed."""
    decoded = F.when(form, F.coalesce(F.try_url_decode(F.regexp_replace(body, r"%(?![0-9A-Fa-f]{2}).{0,1}$", "")), F.translate(body, "+", " "))).otherwise(body)
    return F.regexp_replace(F.lower(decoded), "(…|\\.\\.\\.|\ufffd+)\\s*$", "")


def word_list(text: Column) -> Column:
    """Words with two start marks ahead, so that every text has a last trigram."""
    return F.concat(F.array(F.lit(START), F.lit(START)), F.transform(F.regexp_extract_all(text, F.lit(WORD), 0), lambda w: F.when(w.rlike(r"^\p{N}"), "0").otherwise(w)))


def trigram_counts(texts: DataFrame) -> DataFrame:
    """(a, b, c, inside, terminal) of all texts with a column ``words``."""
    n = F.size("words")
    grams = F.transform(F.sequence(F.lit(1), n - 2), lambda k: F.struct(F.get("words", k - 1).alias("a"), F.get("words", k).alias("b"), F.get("words", k + 1).alias("c"), (k == n - 2).alias("end")))
    g = texts.where(n > 2).select(F.explode(grams).alias("g")).select("g.*")
    return g.groupBy("a", "b", "c").agg(F.count(F.when(~F.col("end"), 1)).alias("inside"), F.count(F.when(F.col("end"), 1)).alias("terminal"))


def endings(counts: DataFrame) -> DataFrame:
    """(a, b, c, inside, terminal) of every last trigram, its last word also as the beginning of longer words.

    A word inside is cut to the lengths that words at ends have behind the same
    two words, and to no others.
    """
    ends = counts.where("terminal > 0").select("a", "b", "c", F.lit(0).cast("long").alias("inside"), "terminal")
    lengths = ends.groupBy("a", "b").agg(F.collect_set(F.length("c")).alias("lengths"))  # at most as many as the longest word has letters
    begun = counts.where("inside > 0").select("a", "b", "c", "inside").join(lengths, ["a", "b"])
    begun = begun.select("a", "b", "c", "inside", F.explode(F.filter("lengths", lambda k: k <= F.length("c"))).alias("k"))
    begun = begun.select("a", "b", F.substring(F.col("c"), F.lit(1), F.col("k")).alias("c"), "inside", F.lit(0).cast("long").alias("terminal"))
    return begun.unionByName(ends).groupBy("a", "b", "c").agg(F.sum("inside").alias("inside"), F.sum("terminal").alias("terminal")).where("terminal > 0")


def upper_share(hits: Column, n: Column, errors: float = ERRORS) -> Column:
    """Wilson's upper bound of a share."""
    p, z2 = hits / n, errors * errors
    return (p + z2 / (2 * n) + errors * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def cut_endings(counts: DataFrame) -> DataFrame:
    e = endings(counts)
    e = e.where(~F.col("c").isin(*STOPS))  # a text that ends a sentence does not look cut
    return e.where(upper_share(F.col("terminal"), F.col("inside") + F.col("terminal")) <= MOST_TERMINAL).select("a", "b", "c")


def media(headers: Column) -> Column:
    return F.lower(F.btrim(F.substring_index(F.coalesce(headers["content-type"], F.lit("")), ";", 1)))


def unclosed(body: Column, kind: Column) -> Column:
    """A JSON or XML text that does not end where its syntax has to."""
    root = F.regexp_extract(body, r"^\s*(?:<\?xml[^>]*\?>\s*)?<([\p{L}_][\p{L}\p{N}_.:-]*)", 1)
    xml_end = F.rtrim(body).endswith(F.concat(F.lit("</"), root, F.lit(">"))) | body.rlike(r"^\s*(?:<\?xml[^>]*\?>\s*)?<[^<>]*/>\s*$")
    json = F.when(body.rlike(r"^\s*\{"), F.json_object_keys(body).isNull()).when(body.rlike(r"^\s*\["), F.json_array_length(body).isNull()).otherwise(F.try_parse_json(body).isNull())
    return F.when(kind.endswith("json"), json).when(kind.endswith("xml"), ~((root != "") & xml_end)).otherwise(False)


def cut_chunks(chunks: DataFrame) -> DataFrame:
    """(id, direction) of captured sides of which a part is missing."""
    missing = (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(1) != 0) | ((F.col("copied_len") > 0) & (F.col("actual_len") > F.col("copied_len")))
    side = F.when(F.col("direction") == 0, "incoming").when(F.col("direction") == 1, "outgoing")
    return chunks.where("txn_id is not null").where(missing).select(F.col("txn_id").alias("id"), side.alias("side")).distinct()


def judged(transactions: DataFrame, chunks: DataFrame, overrule: bool = True) -> DataFrame:
    """(txn_id, capture_source, by_text, by_header, by_syntax, by_chunk, cut): each record with a body, once."""
    kind = media(F.col("req_headers"))
    length = F.regexp_extract(F.col("req_headers")["content-length"], r"^\s*(\d{1,18})\s*$", 1)
    length = F.when(length != "", length.cast("long"))
    body = F.col("req_body")
    rows = transactions.where("txn_id is not null and req_body is not null").select("txn_id", "capture_source", "direction", body, kind.alias("kind"), F.when(length.isNotNull(), length).alias("length"))
    n = F.octet_length("req_body")
    texts = rows.select(
        "txn_id", "capture_source", "direction", "kind", (F.col("length") > n).alias("by_header"), (F.col("length") == n).alias("whole"), unclosed(F.col("req_body"), F.col("kind")).alias("by_syntax"),
        word_list(plain(F.col("req_body"), F.col("kind").endswith("x-www-form-urlencoded"))).alias("words"),
    )
    counts = stored(trigram_counts(texts), "trigrams")
    last = texts.select("txn_id", "capture_source", "direction", "kind", "by_header", "whole", "by_syntax", *(F.try_element_at("words", F.lit(-k)).alias(c) for k, c in ((3, "a"), (2, "b"), (1, "c"))))
    flagged = stored(cut_endings(counts).withColumn("by_text", F.lit(True)), "endings")
    held = flagged.agg(F.sum(F.octet_length("a") + F.octet_length("b") + F.octet_length("c") + 48).alias("n")).first()["n"] or 0  # one number
    if held <= BROADCAST_BYTES:
        flagged = F.broadcast(flagged)  # so that a hot ending gathers no rows; beyond, the planner splits skewed keys
    closed = (F.col("kind").endswith("json") | F.col("kind").endswith("xml")) & ~F.col("by_syntax")
    known = F.lit(overrule) & (F.coalesce("whole", F.lit(False)) | closed)
    per = last.join(flagged, ["a", "b", "c"], "left").select("txn_id", "capture_source", "direction", F.coalesce(F.col("by_text") & ~known, F.lit(False)).alias("by_text"), F.coalesce("by_header", F.lit(False)).alias("by_header"), "by_syntax", F.lit(False).alias("by_chunk"))
    seen = cut_chunks(chunks).select(F.col("id").alias("txn_id"), F.lit(None).cast("string").alias("capture_source"), F.col("side").alias("direction"), *(F.lit(False).alias(c) for c in ("by_text", "by_header", "by_syntax")), F.lit(True).alias("by_chunk"))
    how = ["by_text", "by_header", "by_syntax", "by_chunk"]
    both = per.withColumn("body", F.lit(True)).unionByName(seen.withColumn("body", F.lit(False)))
    one = both.groupBy("txn_id", "direction").agg(F.max("capture_source").alias("capture_source"), *(F.max(c).alias(c) for c in how), F.max("body").alias("body")).where("body")
    return one.groupBy("txn_id").agg(F.max("capture_source").alias("capture_source"), *(F.max(c).alias(c) for c in how)).withColumn("cut", F.greatest(*how))


def trigram_recall(transactions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(kind, n_cut, n_cut_flagged, n_whole, n_whole_flagged): the trigram alone, without overruling, on records of which other evidence tells what they are.

    Known to be cut are those with a chunk, header or syntax that says so; known to be whole those with a
    content-length that is met and no such evidence.
    """
    alone = judged(transactions, chunks, overrule=False)
    length = F.regexp_extract(F.col("req_headers")["content-length"], r"^\s*(\d{1,18})\s*$", 1)
    kind = F.regexp_extract(media(F.col("req_headers")), r"([a-z-]*)$", 1)
    met = (length != "") & (length.cast("long") == F.octet_length("req_body"))
    known = transactions.where("txn_id is not null and req_body is not null").groupBy("txn_id").agg(F.max(kind).alias("kind"), F.min(F.coalesce(met, F.lit(False))).alias("met"))
    cut = F.col("by_header") | F.col("by_syntax") | F.col("by_chunk")
    return alone.join(known, "txn_id").groupBy("kind").agg(
        F.count_if(cut).alias("n_cut"), F.count_if(cut & F.col("by_text")).alias("n_cut_flagged"), F.count_if(~cut & F.col("met")).alias("n_whole"), F.count_if(~cut & F.col("met") & F.col("by_text")).alias("n_whole_flagged")
    )


def rates(found: DataFrame) -> DataFrame:
    """(capture_source, bodies, cut, rate)."""
    return found.groupBy("capture_source").agg(F.count(F.lit(1)).alias("bodies"), F.count_if("cut").alias("n_cut")).withColumn("rate", F.col("n_cut") / F.col("bodies"))
