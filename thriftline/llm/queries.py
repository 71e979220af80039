"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thriftline.llm import chat, corpus, fim, licenses, lmscore, mixing, packing, phrases, quality, secrets, simhash, topk, toxicity, warc
from thriftline.llm.registry import query


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rules(text: str, rules: list[tuple[str, str]]) -> str:
    for pattern, by in rules:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(by)}, 'g')"
    return text


def _references(text: str) -> str:
    number = "TRY_CAST(CASE WHEN name SIMILAR TO '#[0-9]+' THEN name[2:] WHEN name SIMILAR TO '#[xX][0-9A-Fa-f]+' THEN '0x' || name[3:] END AS INTEGER)"
    usable = f"{number} > 0 AND {number} < 1114112 AND NOT {number} BETWEEN 55296 AND 57343"
    character = f"CASE WHEN name[1:1] <> '#' THEN named[name] WHEN {usable} THEN chr({number}) END"
    read = f"list_transform([regexp_extract(part, {_quoted(warc.REFERENCE)}, 1)], lambda name: coalesce({character} || substr(part, length(name) + 2), '&' || part))[1]"
    return f"array_to_string(list_transform(string_split({text}, '&'), lambda part, pos: CASE WHEN pos = 1 THEN part ELSE {read} END), '')"


def _settled(text: str) -> str:
    return f"trim({_rules(text, warc.COLLAPSE)}, chr(32) || chr(10))"


def _link(value: str) -> str:
    read = _references(_rules(value, [(warc.QUOTES, "")]))
    return f"replace(trim({_rules(read, [(warc.LINE_PARTS, '')])}, ' '), ' ', '%20')"


def _uuid(name: str) -> str:
    parts = " || '-' || ".join(f"substr(md5({name}), {at}, {n})" for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"('<urn:uuid:' || {parts} || '>')"


_END = f"'{warc.CRLF}'"


def _derivatives() -> str:
    """The derivatives of ``pages`` in SQL, from the same patterns."""
    line = lambda name, value: f"'{name}: ' || {value} || {_END}"
    each = lambda values, name: f"list_aggregate(list_concat([''], list_transform({values}, lambda v: '{name}: ' || v || {_END})), 'string_agg', '')"
    fields = " || ".join(
        [
            line("source-record-id", "id"), line("source-target-uri", "uri"), line("source-date", "day"),
            line("source-block-digest", "http_digest"), line("source-payload-digest", "body_digest"),
            each(f"string_split(head, {_END})", "source-http"), line("title", "title"), line("conversion", "conversion"),
            each("links", "outlink"),
        ]
    )
    header = " || ".join(
        [
            f"'WARC/1.1' || {_END}", line("WARC-Type", "warc_type"), line("WARC-Record-ID", "record_id"),
            line("WARC-Refers-To", "id"), line("WARC-Refers-To-Target-URI", "uri"), line("WARC-Refers-To-Date", "day"),
            line("WARC-Target-URI", "uri"), line("WARC-Date", "day"), line("WARC-Block-Digest", "'sha256:' || sha256(block)"),
            line("Content-Type", "kind"), line("Content-Length", "strlen(block)"),
        ]
    )
    return f"""
    WITH names AS (
        SELECT MAP {{{", ".join(f"{_quoted(n)}: {_quoted(c)}" for n, c in warc.NAMED.items())}}} AS named
    ), given AS (
        SELECT named, page_id, coalesce(url, '') AS uri, '1970-01-01T00:00:00Z' AS day, coalesce(html, '') AS body,
            {_uuid("'response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')")} AS id
        FROM pages, names
    ), sent AS (
        SELECT *, 'HTTP/1.1 200 OK' || {_END} || 'Content-Type: text/html; charset=utf-8' || {_END}
            || 'Content-Length: ' || strlen(body) AS head, {_rules('body', [(warc.HIDDEN, '')])} AS shown
        FROM given
    ), parsed AS (
        SELECT *, 'sha256:' || sha256(head || {_END} || {_END} || body) AS http_digest, 'sha256:' || sha256(body) AS body_digest,
            {_settled(_references(_rules('shown', warc.TAGS)))} AS plain,
            {_settled(_references(f"regexp_extract(body, {_quoted(warc.TITLE)}, 1)"))} AS title,
            list_transform(regexp_extract_all(shown, {_quoted(warc.HREF)}, 1), lambda x: {_link('x')}) AS links,
            {_uuid("'conversion|' || id")} AS conversion, {_uuid("'metadata|' || id")} AS metadata
        FROM sent
    ), records AS (
        SELECT *, 'metadata' AS warc_type, metadata AS record_id, 'application/warc-fields' AS kind, {fields} AS block FROM parsed
        UNION ALL
        SELECT *, 'conversion', conversion, 'text/plain; charset=utf-8', plain FROM parsed
    )
    SELECT page_id, warc_type, record_id, id AS refers_to, uri AS target_uri, http_digest AS source_block_digest,
        body_digest AS source_payload_digest, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length,
        {header} AS header, block
    FROM records
    """


@query("op1_warc_derivatives", _derivatives())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.responses(corpus.table(spark, sf_dir, "pages"))
    return warc.derivatives(found, ["page_id"])


@query(
    "op2_topk",
    """
    WITH usable AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
    ), ranked AS (
        SELECT query_id, vec_id, score,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM scored
    )
    SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
    """,
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(corpus.table(spark, sf_dir, "embeddings"))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(corpus.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(corpus.table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


@query("op5_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(corpus.table(spark, sf_dir, "documents"))


@query("op6_secrets")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(corpus.table(spark, sf_dir, "documents"))


@query("op7_pseudo_likelihood")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.pseudo_likelihood(corpus.table(spark, sf_dir, "documents"))


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.table(spark, sf_dir, "documents")
    model = toxicity.train(docs, corpus.table(spark, sf_dir, "labels"))
    keep = [F.col("doc_id"), toxicity.held_out().alias("held_out")]
    found = toxicity.scored(docs, model, keep, "doc_id bigint, held_out boolean")
    return found.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(corpus.table(spark, sf_dir, "documents"))


_PROBE = "</s>[INST] ok [/INST]"


@query(
    "op10_chat",
    """
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), sized AS (
        SELECT *,
            length(text) + length(text) - length(replace(text, chr(92), ''))
                + len(regexp_extract_all(text, '</?s>|\\[/?(?:INST|SYS|ROLE)\\]')) AS body,
            length(role) + length(role) - length(replace(role, chr(92), ''))
                + len(regexp_extract_all(role, '</?s>|\\[/?(?:INST|SYS|ROLE)\\]')) AS name
        FROM rows
    )
    SELECT conv_id,
        count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), ''))
            AS loss_sha256,
        CAST(sum(body + CASE role WHEN 'user' THEN 18 WHEN 'system' THEN 16 WHEN 'assistant' THEN 7 ELSE 22 + name END)
            AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = corpus.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", _PROBE), (-1, 1, "assistant", _PROBE)], given.schema)
    return chat.digests(chat.formatted(given.unionByName(probe)))


@query("op11_licenses")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scanned(corpus.table(spark, sf_dir, "documents"))
    base = found.withColumn("base", licenses.base_places(F.col("matches")))
    starts = F.transform("base", lambda m: m["first_word"])
    return base.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        licenses.label_list(F.col("base")).alias("base_labels"),
        licenses.label_list(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["similarity"])), F.lit(0.0)).alias("score"),
    )


@query(
    "op12_phrases",
    """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ), worded AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
    ), totals AS (
        SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM worded GROUP BY lang
    ), counted AS (
        SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS p, count(*) AS a
        FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, range(1, 5) AS lengths(k))
        GROUP BY ALL HAVING count(*) >= 30
    ), candidates AS (
        SELECT *, string_split(p, ' ') AS ws FROM counted WHERE k > 1
    ), absorbing AS (
        SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS p, max(a) AS longer
        FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM candidates, range(2, 4) AS lengths(m) WHERE m < k)
        GROUP BY ALL
    ), cuts AS (
        SELECT c.lang, c.p, c.a, l.a AS l, r.a AS r,
            CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score, c.cut
        FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
        JOIN counted l ON l.lang = c.lang AND l.p = array_to_string(c.ws[1:c.cut], ' ')
        JOIN counted r ON r.lang = c.lang AND r.p = array_to_string(c.ws[c.cut + 1:], ' ')
    ), worst AS (
        SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1
    ), ranked AS (
        SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.p) AS rank, w.p AS phrase,
            w.a, w.l, w.r, t.n, w.score
        FROM worst w JOIN totals t ON t.lang = w.lang LEFT JOIN absorbing x ON x.lang = w.lang AND x.p = w.p
        WHERE x.longer IS NULL OR 100 * CAST(x.longer AS HUGEINT) < 80 * CAST(w.a AS HUGEINT)
    )
    SELECT * FROM ranked WHERE rank <= 2000
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(corpus.table(spark, sf_dir, "documents"))


def _parts(first: str, last: str) -> str:
    return f"array_to_string(units[{first}:{last}], '')"


@query(
    "op13_fill_in_middle",
    f"""
    WITH given AS (
        SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
    ), drawn AS (
        SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
            CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
            CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
        FROM given
    ), cut AS (
        SELECT *, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
            CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), parts AS (
        SELECT *, {_parts('1', 'a')} AS prefix, {_parts('a + 1', 'b')} AS middle, {_parts('b + 1', 'len(units)')} AS suffix FROM cut
    )
    SELECT doc_id, CAST(len(units) AS BIGINT) AS n, form,
        CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
        CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM parts
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transformed(corpus.table(spark, sf_dir, "documents"))
    back = fim.restored(F.col("output"), F.col("form"))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
