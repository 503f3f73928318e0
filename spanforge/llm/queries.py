"""Queries of the problems of training texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanforge.llm import leakage, packing, pii, splitting, truncation
from spanforge.plans.registry import Registry
from spanforge.sources.tables import table

registry = Registry()
query = registry.query


@query("p10_found", "SELECT doc_id FROM documents WHERE n_tokens > 512")
def p10_found(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_tokens")
    return splitting.split(docs, "text", "n_tokens").where("piece.no = 1").select("doc_id").distinct()


@query("p10_pieces")
def p10_pieces(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_tokens").where("n_tokens is null or n_tokens > 512")
    return splitting.split(docs, "text", "n_tokens").select("doc_id", "piece.*")


#: Words as TESTDATA.md has them; DuckDB has no NFKC, so the wide and joined forms that occur are spelt out.
_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_NARROW = "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")


def _words_sql(text: str) -> str:
    plain = f"regexp_replace({text}, '[\u00ad\u180e\u200b\u200c\u200d\u2060\ufeff]', '', 'g')"
    for a, b in (("\ufb00", "ff"), ("\ufb01", "fi"), ("\ufb02", "fl"), ("\ufb03", "ffi"), ("\ufb04", "ffl"), ("\ufb05", "st"), ("\ufb06", "st"), ("\u2026", "...")):
        plain = f"replace({plain}, '{a}', '{b}')"
    return f"regexp_extract_all(lower(nfc_normalize(translate({plain}, '{_WIDE}', '{_NARROW}'))), '[\\p{{L}}\\p{{N}}]+')"


LEAKED_SQL = f"""
WITH d AS (SELECT doc_id, {_words_sql("text")} AS w FROM documents), e AS (SELECT item_id, {_words_sql("item_text")} AS w FROM eval_items),
dg AS (SELECT DISTINCT doc_id, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4], w[i+5], w[i+6], w[i+7], w[i+8], w[i+9], w[i+10], w[i+11]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, hash(w[i], w[i+1], w[i+2], w[i+3], w[i+4], w[i+5], w[i+6], w[i+7], w[i+8], w[i+9], w[i+10], w[i+11]) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM e)),
p AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g))
"""


def _matcher(spark, d):
    docs, items = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "eval_items").select("item_id", "item_text")
    return leakage.Matcher(docs, "doc_id", "text", items, "item_id", "item_text")


@query("p9_found", LEAKED_SQL + "SELECT doc_id, item_id FROM p")
def p9_found(spark, d):
    return _matcher(spark, d).leaked().select("doc_id", "item_id")


@query("p9_items", LEAKED_SQL + "SELECT item_id, CAST(count(*) AS BIGINT) AS n_docs FROM p GROUP BY item_id")
def p9_items(spark, d):
    """Each leaked item with the number of documents it leaks into."""
    return p9_found(spark, d).groupBy("item_id").agg(F.count("doc_id").alias("n_docs"))


@query("p9_classes")
def p9_classes(spark, d):
    """Documents with the window classes they leak: (doc_id, class_id, n_windows)."""
    return _matcher(spark, d).leaked_classes()


@query("p9_members")
def p9_members(spark, d):
    """The items of each window class: (class_id, item_id)."""
    return _matcher(spark, d).window_members()


@query("p9_variants")
def p9_variants(spark, d):
    """Documents with re-parameterised items: (doc_id, item_id, n_windows)."""
    return _matcher(spark, d).variants()


@query("p9_variant_classes")
def p9_variant_classes(spark, d):
    """Documents with the item classes they re-parameterise or copy: (doc_id, class_id, n_windows)."""
    return _matcher(spark, d).variant_classes()


@query("p9_variant_members")
def p9_variant_members(spark, d):
    """The items of each item class: (item_id, class_id)."""
    return _matcher(spark, d).item_classes()


@query("p10_whole", "SELECT doc_id, n_tokens, true AS fits, true AS overlaps, true AS whole FROM documents WHERE n_tokens > 512")
def p10_whole(spark, d):
    """What must hold of the pieces of each text: at most 512 tokens, 32 shared with the piece before, and without those the text itself."""
    docs = table(spark, d, "documents").select("doc_id", "text", "n_tokens").where("n_tokens > 512")
    p = splitting.split(docs, "text", "n_tokens")
    own = F.regexp_extract_all(F.col("piece.text"), F.lit(splitting.UNIT), 0)
    fresh = F.array_join(F.slice(own, F.when(F.col("piece.no") > 0, 33).otherwise(1), F.size(own) + 1), "")
    parts = p.groupBy("doc_id").agg(
        F.max("text").alias("text"), F.max("n_tokens").alias("n"), F.max("piece.end").alias("end"), F.max("piece.n_tokens").alias("most"), F.sort_array(F.collect_list(F.struct(F.col("piece.no").alias("no"), F.col("piece.start").alias("start"), F.col("piece.end").alias("end"), fresh.alias("fresh")))).alias("p")
    )  # the pieces of one text
    overlaps = F.forall(F.sequence(F.lit(1), F.size("p") - 1), lambda k: F.get("p", k)["start"] == F.get("p", k - 1)["end"] - 32)
    return parts.select("doc_id", F.col("end").cast("long").alias("n_tokens"), (F.col("most") <= 512).alias("fits"), overlaps.alias("overlaps"), (F.array_join(F.transform("p", lambda x: x["fresh"]), "") == F.col("text")).alias("whole"))


def _packed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "n_tokens")
    return packing.pack(docs, "doc_id", "text", "n_tokens")


@query("p8_found", "SELECT doc_id FROM documents WHERE n_tokens > 2048")
def p8_found(spark, d):
    """Documents in more than one piece."""
    return _packed(spark, d).where("piece > 0").select(F.col("id").alias("doc_id")).distinct()


@query("p8_containers")
def p8_containers(spark, d):
    return _packed(spark, d).withColumnRenamed("id", "doc_id")


@query("p8_whole", "SELECT doc_id, n_tokens, true AS fits FROM documents WHERE text IS NOT NULL")
def p8_whole(spark, d):
    """What must hold of the containers: every text in them once and whole, no container over its capacity."""
    p = _packed(spark, d)
    full = p.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    return p.join(full, "container").groupBy(F.col("id").alias("doc_id")).agg(F.sum("n_tokens").alias("n_tokens"), (F.max("held") <= packing.CAPACITY).alias("fits"))


@query("p8_room", "SELECT CAST(sum(n_tokens) AS BIGINT) AS tokens, true AS full FROM documents WHERE text IS NOT NULL")
def p8_room(spark, d):
    """All tokens, and whether at most a hundredth of the room stays empty, but for one container a task."""
    c = _packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    tasks = F.count_distinct(F.shiftright("container", 40))
    return c.agg(F.sum("n").alias("tokens"), (F.sum("n") >= 0.99 * packing.CAPACITY * (F.count(F.lit(1)) - tasks)).alias("full"))


@query("p8_fill")
def p8_fill(spark, d):
    """How full the containers are: number, tokens, share of room used, fewest and most tokens."""
    c = _packed(spark, d).groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return c.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count(F.lit(1)) * packing.CAPACITY)).alias("fill"), F.min("n").alias("least"), F.max("n").alias("most"))


def _judged(spark, d):
    return truncation.judged(table(spark, d, "transactions"), table(spark, d, "chunks"))


@query("p2_found")
def p2_found(spark, d):
    return _judged(spark, d).where("cut").select("txn_id")


@query("p2_rates")
def p2_rates(spark, d):
    """How often each capture source cuts bodies."""
    return truncation.rates(_judged(spark, d))


CUT_SQL = """
WITH b AS (SELECT *, lower(trim(split_part(coalesce(req_headers['content-type'], ''), ';', 1))) AS kind FROM transactions WHERE req_body IS NOT NULL AND txn_id IS NOT NULL),
c AS (SELECT DISTINCT txn_id, CASE direction WHEN 0 THEN 'incoming' WHEN 1 THEN 'outgoing' END AS direction FROM chunks WHERE flags & 1 <> 0 OR (copied_len > 0 AND actual_len > copied_len)),
r AS (SELECT b.txn_id, TRY_CAST(nullif(regexp_extract(req_headers['content-length'], '^\\s*(\\d{1,18})\\s*$', 1), '') AS BIGINT) > strlen(req_body) AS by_header, c.txn_id IS NOT NULL AS by_chunk, kind LIKE '%json' AND NOT json_valid(req_body) AS by_json
      FROM b LEFT JOIN c ON b.txn_id = c.txn_id AND b.direction = c.direction)
SELECT txn_id, coalesce(bool_or(by_header), false) AS by_header, coalesce(bool_or(by_chunk), false) AS by_chunk, coalesce(bool_or(by_json), false) AS by_json FROM r GROUP BY txn_id
"""


@query("p2_evidence", CUT_SQL)
def p2_evidence(spark, d):
    """The exact evidence of every record with a body: header, chunk, and syntax of JSON."""
    t = table(spark, d, "transactions")
    json = t.where("req_body is not null").groupBy("txn_id").agg(F.max(truncation.media(F.col("req_headers")).endswith("json")).alias("json"))
    return _judged(spark, d).join(json, "txn_id").select("txn_id", "by_header", "by_chunk", (F.col("by_syntax") & F.col("json")).alias("by_json"))


@query("p2_trigram")
def p2_trigram(spark, d):
    """What the trigram alone finds among records known to be cut or whole, by kind of content."""
    return truncation.trigram_recall(table(spark, d, "transactions"), table(spark, d, "chunks"))


@query("p6_found")
def p6_found(spark, d):
    return pii.found(table(spark, d, "transactions"))


@query("p6_redacted")
def p6_redacted(spark, d):
    """The four fields of every row of transactions with findings replaced by placeholders."""
    return pii.redacted(table(spark, d, "transactions")).withColumnRenamed("id", "txn_id")


@query("p6_clean", "SELECT 'body' AS field, CAST(count(req_body) AS BIGINT) AS n, true AS clean FROM transactions UNION ALL SELECT 'path', CAST(count(req_path) AS BIGINT), true FROM transactions UNION ALL SELECT 'query', CAST(count(req_query) AS BIGINT), true FROM transactions UNION ALL SELECT 'headers', CAST(count(req_headers) AS BIGINT), true FROM transactions")
def p6_clean(spark, d):
    """The redacted fields: as many as before, and read again nothing is found in them."""
    r = pii.redacted(table(spark, d, "transactions")).withColumnRenamed("id", "txn_id")
    names = {"body": "req_body", "path": "req_path", "query": "req_query", "headers": "req_headers"}
    n = r.agg(*(F.count(c).alias(k) for k, c in names.items())).select(F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(k).alias("n")) for k in names))).alias("x")).select("x.*")
    left = pii.found(r).groupBy("field").agg(F.count(F.lit(1)).alias("left"))
    return n.join(left, "field", "left").select("field", "n", (F.coalesce("left", F.lit(0)) == 0).alias("clean"))


#: Spellings that patterns can tell for certain.
_CERTAIN = {
    "email": r"(^|[^A-Za-z0-9.+%_-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)*[.][A-Za-z]{2,}([^A-Za-z0-9.@-]|[.]?$|[.][^A-Za-z0-9])",
    "national_id": r"(^|[^A-Za-z0-9.+/ -] ?|[a-z] )(0[1-9][0-9]|00[1-9]|[1-57-8][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(0[1-9]|[1-9][0-9])-(000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})([^A-Za-z0-9 ./()+-]|[.]?$| [A-Za-z])",
}


@query("p6_certain", " UNION ALL ".join(f"SELECT DISTINCT txn_id, '{k}' AS pii_type FROM transactions WHERE regexp_matches(req_body, '{p}')" for k, p in _CERTAIN.items()))
def p6_certain(spark, d):
    """Bodies with an address or number in its plainest spelling that are found to have one: all of them."""
    t = table(spark, d, "transactions")
    f = pii.found(t).where("field = 'body'").select("txn_id", "pii_type")
    plain = [t.where(F.col("req_body").rlike(p)).select("txn_id", F.lit(k).alias("pii_type")) for k, p in _CERTAIN.items()]
    return f.join(plain[0].unionByName(plain[1]), ["txn_id", "pii_type"], "left_semi")
