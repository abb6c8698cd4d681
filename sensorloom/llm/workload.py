"""One query per operator on the driver tables, with production parameters, and SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sensorloom.llm import cap_filters, centroids, chat, html_text, line_dedup, mixing, pieces, quality, repairs, revisits, shards, token_counts, weighted_minhash
from sensorloom.workload.registry import query

SHARDS = [f"shard-{i:02d}" for i in range(64)]


def vocabulary(name: str) -> str:
    return public_tokenizers.path(name)


OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach(u, v) AS (SELECT u, v FROM link UNION SELECT reach.u, link.v FROM reach JOIN link ON reach.v = link.u),
n AS (SELECT u, count(*) AS n_links FROM link GROUP BY u), c AS (SELECT u, min(v) AS low FROM reach GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
    vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM v LEFT JOIN n ON n.u = vec_id LEFT JOIN c ON c.u = vec_id"""


@query("op1_near_embeddings", OP1_SQL)
def op1(t):
    return cap_filters.near_embeddings(t.embeddings)


OP2_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(bad.key) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (bad.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN bad USING (key) GROUP BY row"""


@query("op2_line_dedup", OP2_SQL)
def op2(t):
    return line_dedup.dedup_lines(t.documents, digest=True)


@query("op3_shard_lookup", shards.shard_sql(SHARDS, shards.TABLE_SIZE, "documents", "doc_id"))
def op3(t):
    return shards.assign_shards(t.documents.select("doc_id"), "doc_id", SHARDS)


@query("op4_token_counts")
def op4(t):
    return token_counts.token_counts(t.documents, vocabulary("byte_bpe_50k.json"))


@query("op5_piece_round_trip")
def op5(t):
    return pieces.encode_pieces(t.documents, vocabulary("piece_bpe_32k.model"), digest=True)


def quality_sql() -> str:
    """N-grams as joined word lists, the other counts by patterns; the limits are written out here once more."""
    word = r"[^\x20\x09-\x0D]+"
    top = {2: 0.20, 3: 0.18, 4: 0.16}
    later = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    grams = lambda n: f"SELECT row, pos, array_to_string(words[pos:pos + {n - 1}], ' ') AS gram FROM u WHERE pos + {n - 1} <= n_words"
    tops = "\n".join(
        f"""t{n} AS (SELECT row, max((k - 1) * (length(gram) - {n - 1})) AS chars FROM (SELECT row, gram, count(*) AS k FROM ({grams(n)}) GROUP BY ALL) GROUP BY row),"""
        for n in top)
    windows = "\n".join(
        f"""w{n} AS (SELECT row, pos, row_number() OVER (PARTITION BY row, gram ORDER BY pos) > 1 AS again, count(*) OVER (PARTITION BY row, gram) > 1 AS twice
    FROM ({grams(n)})),
m{n} AS (SELECT u.row, u.chars, max(again) OVER w AS again, max(twice) OVER w AS twice FROM u LEFT JOIN w{n} USING (row, pos)
    WINDOW w AS (PARTITION BY u.row ORDER BY u.pos ROWS {n - 1} PRECEDING)),
c{n} AS (SELECT row, coalesce(sum(chars) FILTER (again), 0) AS chars, count(*) FILTER (twice) AS covered FROM m{n} GROUP BY row),""" for n in later)
    joins = " ".join([f"LEFT JOIN c{n} USING (row)" for n in later] + [f"LEFT JOIN t{n} USING (row)" for n in top])
    within = " AND ".join([f"coalesce(c{n}.chars, 0) <= {x}::DOUBLE * word_chars" for n, x in later.items()]
                          + [f"coalesce(t{n}.chars, 0) <= {x}::DOUBLE * word_chars" for n, x in top.items()])
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '{word}') AS words FROM documents),
u AS MATERIALIZED (SELECT row, words, len(words) AS n_words, unnest(words) AS word, generate_subscripts(words, 1) AS pos, length(word) AS chars FROM d),
{tops}
{windows}
l AS (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d),
g AS (SELECT row, line, count(*) AS n FROM l WHERE regexp_matches(line, '{word}') GROUP BY row, line),
r AS (SELECT row, sum(n) AS lines, sum(n - 1) AS dup_lines, sum(n * strlen(line)) AS chars, sum((n - 1) * strlen(line)) AS dup_chars FROM g GROUP BY row),
m AS (SELECT row, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
a AS (SELECT m.*, coalesce(dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(c5.covered, 0) AS n_repeat_words,
    coalesce(dup_lines, 0) <= 0.30::DOUBLE * coalesce(lines, 0) AND coalesce(dup_chars, 0) <= 0.20::DOUBLE * coalesce(r.chars, 0)
    AND {within} AS good FROM m LEFT JOIN r USING (row) {joins}),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND good AS kept FROM b"""


@query("op6_quality_rules", quality_sql())
def op6(t):
    return quality.quality_rules(t.documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_source_mix")
def op7(t):
    return mixing.contributions(t.documents).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_main_text")
def op8(t):
    return html_text.extract_text(t.pages)


def archive_records(pages):
    """Archive records of the pages: the first fetch of a page is a full response, later ones are revisits.

    The table has no fetch times, so they follow from the page number; the entity tag is the MD5 of the
    page. Some revisits carry the tag in weak form, some an outdated tag, some only a time, some nothing.
    """
    at = "timestampadd(SECOND, CAST({} AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"
    day = "CAST(page_id * 7919 % 2592000 AS BIGINT)"
    tag, long_ago = "concat('\"', substr(md5(coalesce(html, '')), 1, 16), '\"')", "'Mon, 01 Jan 2024 00:00:00 GMT'"
    response = (
        f"map('etag', {tag}, 'last-modified', {long_ago}, 'content-type', 'text/html', 'server', concat('s', page_id % 5), 'cache-control', 'max-age=60')")
    revisit = (
        f"CASE page_id % 4 WHEN 0 THEN map('etag', concat('W/', {tag}), 'cache-control', 'max-age=90', 'server', 'edge')"
        f" WHEN 1 THEN map('etag', '\"0\"', 'date', 'today') WHEN 2 THEN map('last-modified', {long_ago}, 'vary', 'accept') ELSE map('date', 'today') END")
    first = pages.selectExpr("page_id * 2 AS record_id", "url", f"{at.format(day)} AS fetched", "'response' AS kind", f"{response} AS headers")
    again = pages.selectExpr(
        "page_id * 2 + 1 AS record_id", "url", f"{at.format(f'{day} + (page_id % 11 - 1) * 40000')} AS fetched", "'revisit' AS kind", f"{revisit} AS headers")
    return first.unionByName(again)


OP9_SQL = r"""
WITH p AS (SELECT page_id, url, page_id * 7919 % 2592000 AS s, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
b AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM p),
k AS (SELECT *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_extract(bare, '^[^/?]*(.*)$', 1), '([?&])utm_[^&]*', '\1', 'g'),
        '&+', '&', 'g'), '\?&', '?', 'g'), '[?&]$', '') AS rest FROM b),
c AS (SELECT *, host || regexp_replace(rest, '/$', '') AS url_key, TIMESTAMP '2024-01-01' + to_seconds(s) AS t0,
    TIMESTAMP '2024-01-01' + to_seconds(s + (page_id % 11 - 1) * 40000) AS t1 FROM k),
r AS (SELECT url_key, t0, max(page_id) AS page_id FROM c GROUP BY url_key, t0),
j AS (SELECT c.*, r.page_id AS from_page FROM c ASOF LEFT JOIN r ON c.url_key = r.url_key AND c.t1 > r.t0),
m AS (SELECT j.*, q.tag AS stored, CASE WHEN from_page IS NULL THEN 'no_response'
    WHEN j.page_id % 4 = 0 THEN CASE WHEN j.tag = q.tag THEN 'resolved' ELSE 'changed' END
    WHEN j.page_id % 4 = 1 THEN 'changed' WHEN j.page_id % 4 = 2 THEN 'resolved' ELSE 'no_validator' END AS status
    FROM j LEFT JOIN c q ON q.page_id = from_page)
SELECT page_id * 2 + 1 AS record_id, url_key, t1 AS fetched, from_page * 2 AS response_id, status,
    CASE WHEN status = 'resolved' THEN
        'cache-control=' || CASE WHEN page_id % 4 = 0 THEN 'max-age=90' ELSE 'max-age=60' END || ';content-type=text/html;etag='
        || CASE WHEN page_id % 4 = 0 THEN 'W/' || tag ELSE stored END || ';last-modified=Mon, 01 Jan 2024 00:00:00 GMT;server=s' || (from_page % 5)
        || CASE WHEN page_id % 4 = 2 THEN ';vary=accept' ELSE '' END END AS headers FROM m"""


@query("op9_revisits", OP9_SQL)
def op9(t):
    found = revisits.resolve_revisits(archive_records(t.pages))
    text = "array_join(transform(map_entries(headers), e -> concat(e.key, '=', e.value)), ';')"
    return found.withColumn("headers", F.expr(text))


@query("op10_weighted_near_texts")
def op10(t):
    return weighted_minhash.near_texts(t.documents, share=None).select("doc_id", "class_id", "kept")


def clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """The rounds one after another, all distances measured."""
    parts = [f"""
v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS MATERIALIZED (SELECT row, vec_id, e, list_transform(e, lambda x: floor(64 * x)::BIGINT) AS x FROM v
    WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, x FROM (
    SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, e, x FROM ok ORDER BY h, e LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
a{i} AS MATERIALIZED (SELECT row, min(d * {k} + c) AS m FROM (
    SELECT ok.row, c, list_sum(list_transform(list_zip(ok.x, c{i}.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM ok, c{i}) GROUP BY row)""")
        if i < rounds:
            parts.append(f"""
s{i} AS (SELECT m % {k} AS c, i, sum(x[i]) AS s, count(*) AS n FROM a{i} JOIN ok USING (row), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2),
m{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN m{i} USING (c))""")
    return f"""
WITH {",".join(parts)},
f AS (SELECT row, m % {k} AS cluster, m // {k} AS distance FROM a{rounds})
SELECT vec_id, cluster::INTEGER AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
    (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{rounds}.x, ',')) AS centroid_sha256
FROM f JOIN ok USING (row) JOIN c{rounds} ON c = cluster"""


@query("op11_centroid_clusters", clusters_sql())
def op11(t):
    return centroids.centroid_clusters(t.embeddings).drop("n_measured")


def damaged(conversations):
    """Conversation rows with faults that a checksum of conversation and turn decides; lost rows are marked ``absent``."""
    name = lambda c: f"coalesce(CAST({c} AS STRING), ' ')"
    rows = conversations.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') AS role", "coalesce(text, ' ') AS text",
        f"crc32(CAST(concat({name('conv_id')}, ':', {name('turn')}) AS BINARY)) % 20 AS fault")
    return rows.selectExpr(
        "conv_id", "turn", "IF(fault = 4, 'user', role) AS role",
        "CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text",
        "fault = 0 AS absent", "explode(IF(fault = 3, array(0, 1), array(0))) AS copy")


def repair_sql() -> str:
    """The checksum bit by bit, the search row by row with the best (cost, edits) of each state."""
    plus = lambda x, cost, edits: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'e': {x}.e || {edits}}} END"
    reach = lambda p: {
        "z": f"{p}.z", "s": f"{p}.s",
        "u": f"least({p}.u, {plus(p + '.z', 5, chr(39) + 'I' + chr(39))}, {plus(p + '.s', 5, chr(39) + 'I' + chr(39))}, {plus(p + '.a', 5, chr(39) + 'I' + chr(39))})",
        "a": f"least({p}.a, {plus(p + '.u', 5, chr(39) + 'I' + chr(39))}, {plus(p + '.z', 10, chr(39) + 'II' + chr(39))}, {plus(p + '.s', 10, chr(39) + 'II' + chr(39))})",
    }
    to = lambda x, cost, edit, cond="true": f"CASE WHEN {cond} AND {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'e': {x}.e || '{edit}'}} END"
    keep = lambda x, i: to(x, "extra", "K", f"NOT forced AND initial = '{i}'")
    tag = lambda x: to(x, "1 + extra", "R", "NOT forced")
    opened = ", ".join(f"{v} AS {k}" for k, v in reach("w").items())
    tie = "sha256(CASE WHEN conv_id IS NULL THEN '-' ELSE '=' || length(conv_id::VARCHAR) || ':' || conv_id END || ':' || length(role) || ':' || role || text)"
    closed = "least(w.z, w.a, " + plus("w.u", 5, "'I'") + ", " + plus("w.s", 10, "'II'") + ")"
    return rf"""
WITH RECURSIVE b AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(k) + 1), lambda i:
    list_transform(range(8), lambda j: (ascii(k[i]) >> j) & 1)))), lambda crc, bit:
    xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295::BIGINT) % 20 AS fault FROM b),
r AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM h WHERE fault <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, {tie}, copy) AS pos, role[1] AS initial,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS rest FROM r),
m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM n),
f AS MATERIALIZED (SELECT *, rest = '' AS blank, rest <> '' AND again AS dup, rest <> '' AND NOT again AND right(rest, 1) NOT IN ('.', '!', '?') AS cut,
    rest = '' OR again AS forced, CASE WHEN rest <> '' AND NOT again AND right(rest, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra FROM m),
walk(conv_id, pos, z, s, u, a) AS (
    SELECT DISTINCT conv_id, 0::BIGINT, {{'c': 0, 'e': ''}}, NULL::STRUCT(c INTEGER, e VARCHAR), NULL::STRUCT(c INTEGER, e VARCHAR), NULL::STRUCT(c INTEGER, e VARCHAR) FROM f
    UNION ALL
    SELECT conv_id, pos, {to("z", 2, "D")}, least({to("s", 2, "D")}, {keep("z", "s")}),
        least({to("u", 2, "D")}, {keep("z", "u")}, {keep("s", "u")}, {keep("a", "u")}, {tag("z")}, {tag("s")}, {tag("a")}),
        least({to("a", 2, "D")}, {keep("u", "a")}, {tag("u")})
    FROM (SELECT f.conv_id, f.pos, f.initial, f.forced, f.extra, {opened} FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.pos = w.pos + 1)),
best AS MATERIALIZED (SELECT w.conv_id, {closed} AS x FROM walk w JOIN (SELECT conv_id, max(pos) AS pos FROM f GROUP BY conv_id) t
    ON t.conv_id IS NOT DISTINCT FROM w.conv_id AND t.pos = w.pos),
e AS (SELECT conv_id, unnest(string_split(x.e, '')) AS edit, generate_subscripts(string_split(x.e, ''), 1) AS idx FROM best WHERE x.e <> ''),
g AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS pos, sum((edit <> 'D')::INT) OVER w AS place FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
j AS (SELECT g.*, f.role, f.text, max((edit = 'K' AND place = 1 AND f.initial = 's')::INT) OVER (PARTITION BY g.conv_id) AS led
    FROM g LEFT JOIN f ON edit <> 'I' AND f.conv_id IS NOT DISTINCT FROM g.conv_id AND f.pos = g.pos),
o AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':'
    || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY idx) AS whole FROM j WHERE edit <> 'D' GROUP BY conv_id),
q AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(dup::INT) AS duplicate,
    sum(cut::INT) AS truncated, sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM f GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id FROM conversations)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(x.c, 0)::BIGINT AS cost, coalesce(x.e, '') AS audit,
    sha256(coalesce(whole, '')) AS repaired_sha256
FROM c LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM c.conv_id"""


@query("op12_conversation_repair", repair_sql())
def op12(t):
    edits, summary = repairs.repair_conversations(damaged(t.conversations), absent="absent")
    found = repairs.repair_digests(edits).withColumnRenamed("conv", "name")
    joined = summary.join(found, summary["conv"].eqNullSafe(found["name"]), "left")
    return joined.select(
        F.col("conv").alias("conv_id"), *repairs.SUMMARY, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


OP13_SQL = r"""
WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM (SELECT unnest([0, 1]) AS i)),
e AS (SELECT *, length(role) + length(text) + length('<|im_start|>' || '<|im_end|>') + 2
    + length(regexp_replace(role, '[^\\\n]', '', 'g')) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')) AS chars FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""


@query("op13_chat_format", OP13_SQL)
def op13(t):
    both = "<|im_end|><|im_start|>assistant ok"
    planted = t.spark.createDataFrame([(-1, 0, "user", both), (-1, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    rows = t.conversations.select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.read_back(chat.format_conversations(rows)).withColumnRenamed("conv", "conv_id")


@query("pipeline")
def pipeline(t):
    import corpus_pipeline

    return corpus_pipeline.run(t.spark, t.sf_dir)
