"""DuckDB twins of the derived tables and of every query that SQL can state."""

from __future__ import annotations

import re

from ..functions import prompts
from ..functions.privacy import ADDRESS_PATTERNS, NAME_PATTERNS, NUMBER_PATTERNS
from ..plans import replies
from . import lexicons
from .tables import CONTACT

DIM = 64


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(values) -> str:
    return "(" + ", ".join(quoted(v) for v in values) + ")"


def redacted(expr: str) -> str:
    for pattern, label in (*ADDRESS_PATTERNS, *NUMBER_PATTERNS, *NAME_PATTERNS):
        expr = f"regexp_replace({expr}, {quoted(pattern)}, {quoted(label.replace('$', chr(92)))}, 'g')"
    return expr


def stripped(expr: str) -> str:
    return f"trim({expr}, ' '||chr(9)||chr(10)||chr(13))"


def sentence(expr: str) -> str:
    """The first sentence, or all of it where none ends."""
    return f"coalesce(nullif(regexp_extract({expr}, '(?s)^(.*?[.!?])(?:\\s|$)', 1), ''), {expr})"


def first_rule(expr: str, rules, default: str) -> str:
    arms = "".join(
        f" WHEN regexp_matches(lower({expr}), {quoted(r'(^|[^\p{L}])(?:' + '|'.join(found) + r')([^\p{L}]|$)')}) THEN {quoted(label)}"
        for label, found in rules
    )
    return f"CASE{arms} ELSE {quoted(default)} END"


def tokens(expr: str) -> str:
    return f"list_filter(string_split_regex(lower({expr}), '[^\\p{{L}}]+'), lambda w: w <> '')"


def hits(tok: str, found) -> str:
    return f"len(list_filter({tok}, lambda w: w IN {words(found)}))"


def record(raw: str, source: str, subject: str, body: str, answer: str) -> str:
    about = f"coalesce({subject}, '') || ' ' || coalesce({body}, '')"
    return f"""
      {quoted(source)} AS source, md5({raw}) AS source_key,
      {redacted(subject)} AS subject, {redacted(body)} AS body, {redacted(answer)} AS answer,
      {first_rule(about, lexicons.TYPES, 'Other')} AS type,
      {first_rule(about, lexicons.PRIORITIES, 'low')} AS priority"""


def vectors(name: str, source: str, key: str, text: str) -> dict[str, str]:
    """CTEs that hash the words of ``text`` into vectors; last is ``name``(id, vec)."""
    return {
        f"{name}_w": f"SELECT {key} AS id, unnest({tokens(text)}) AS w FROM {source}",
        f"{name}_c": f"SELECT id, CAST('0x'||substr(md5(w), 1, 7) AS BIGINT) % {DIM} AS b, count(*) AS c FROM {name}_w GROUP BY ALL",
        f"{name}_m": f"SELECT id, sqrt(sum(c * c)) AS norm, map(list(b), list(c)) AS m FROM {name}_c GROUP BY id",
        name: f"SELECT id, list_transform(range({DIM}), lambda i: coalesce(m[i], 0) / norm) AS vec FROM {name}_m",
    }


def nearest(name: str, base: str, queries: str, k: int, distance: str = "list_distance(q.vec, b.vec)") -> dict[str, str]:
    """CTE ``name``(query_id, base_id, distance, rank) over CTEs with (id, vec)."""
    return {
        f"{name}_p": f"SELECT q.id AS query_id, b.id AS base_id, round({distance}, 12) AS distance FROM {queries} q, {base} b",
        f"{name}_r": f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS rank FROM {name}_p",
        name: f"SELECT * FROM {name}_r WHERE rank <= {k}",
    }


def spread(name: str, label: str, rounds: int = 3) -> dict[str, str]:
    """CTEs that spread a label of taught forms over ``node_edges``; last is ``name``(node, label, score), without abstention."""
    ctes = {
        f"{name}_seed": f"""SELECT node, label, 1000000 * count(*) // sum(count(*)) OVER (PARTITION BY node) AS s FROM (
            SELECT ticket_id, {label} AS label FROM tickets WHERE source = 'form' AND ticket_id % 5 <> 0) JOIN node_members USING (ticket_id)
            WHERE label IS NOT NULL GROUP BY node, label""",
        f"{name}_free": f"SELECT a, b, w, sum(w) OVER (PARTITION BY a) AS total FROM node_edges WHERE a NOT IN (SELECT node FROM {name}_seed)",
        f"{name}_0": f"SELECT node, label, CAST(s AS BIGINT) AS s FROM {name}_seed",
    }
    for i in range(rounds):
        ctes[f"{name}_{i + 1}"] = f"""SELECT node, label, CAST(s AS BIGINT) AS s FROM {name}_0 UNION ALL
            SELECT a, label, CAST(80 * sum(w * s) // (100 * any_value(total)) AS BIGINT) FROM {name}_free JOIN {name}_{i} ON b = node GROUP BY a, label"""
    ctes[name] = f"SELECT node, arg_min(label, (-s, label)) AS label, max(s) AS score FROM {name}_{rounds} GROUP BY node"
    return ctes


def sparse(name: str, source: str, key: str, text: str, dim: int = 16384) -> dict[str, str]:
    """CTE ``name``(id, b, x): hashed words by bucket, scaled to length 1 by text."""
    return {
        f"{name}_t": f"SELECT {key} AS id, unnest({tokens(text)}) AS w FROM {source}",
        f"{name}_n": f"SELECT id, CAST('0x'||substr(md5(w), 1, 7) AS BIGINT) % {dim} AS b, count(*) AS c FROM {name}_t GROUP BY ALL",
        name: f"SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM {name}_n",
    }


def logistic(name: str, label: str, steps: int = 8, rate: float = 2.0, l2: float = 1e-4) -> dict[str, str]:
    """CTEs of accelerated gradient steps over ``doc_features``; last is ``name``(b, w), the constant at b = -1."""
    ctes = {
        f"{name}_y": f"""SELECT doc_id AS id, {label} AS y, 0.5::DOUBLE / count(*) OVER (PARTITION BY {label}) AS v
            FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0 AND {label} IN (0, 1) AND text IS NOT NULL""",
        f"{name}_f": f"SELECT id, b, x, y, v FROM doc_features JOIN {name}_y USING (id) UNION ALL SELECT id, -1, 1, y, v FROM {name}_y",
        f"{name}_0": f"SELECT DISTINCT b, 0::DOUBLE AS w, 0::DOUBLE AS former FROM {name}_f",
    }
    for i in range(steps):
        ctes[f"{name}_a{i}"] = f"SELECT b, w, w + {i}::DOUBLE / {i + 3} * (w - former) AS ahead FROM {name}_{i}"
        ctes[f"{name}_e{i}"] = f"""SELECT id, (1 / (1 + exp(-sum(ahead * x))) - any_value(y)) * any_value(v) AS e
            FROM {name}_f JOIN {name}_a{i} USING (b) GROUP BY id"""
        ctes[f"{name}_{i + 1}"] = f"""SELECT b, any_value(ahead) - {rate} * (sum(x * e) + CASE WHEN b >= 0 THEN {l2} ELSE 0 END * any_value(ahead)) AS w,
            any_value(w) AS former FROM {name}_f JOIN {name}_e{i} USING (id) JOIN {name}_a{i} USING (b) GROUP BY b"""
    ctes[name] = f"SELECT b, w FROM {name}_{steps}"
    return ctes


def probability(name: str, features: str) -> str:
    return f"""(SELECT id, sum(x * w) AS logit FROM {features} JOIN {name} USING (b) GROUP BY id)"""


def vector_code(vec: str) -> str:
    return f"array_to_string(list_transform({vec}, lambda x: CAST(CAST(floor(x * 1000000) AS BIGINT) AS VARCHAR)), ',')"


BS_N = "chr(92) || 'n'"
Q = "chr(34)"

CTES: dict[str, str] = {
    "lines": "SELECT doc_id, lang, source, n_chars, string_split(text, chr(10)) AS a FROM documents",
    "fields": """SELECT doc_id, lang, source AS doc_source, n_chars, a AS lines, a[1] AS subject,
        coalesce(array_to_string(a[2:len(a) - 1], ' '), '') AS body, a[-1] AS answer FROM lines""",
    "raw_forms": """SELECT subject, body, answer, doc_source AS type,
        CASE WHEN n_chars > 6000 THEN 'urgent' WHEN n_chars > 3000 THEN 'High' WHEN n_chars > 1500 THEN 'medium'
             WHEN n_chars > 700 THEN 'p1' END AS priority FROM fields WHERE coalesce(lang, '') NOT IN ('fr', 'es', 'de')""",
    "raw_emails": f"""SELECT *, {Q} || 'Subject: ' || subject || {BS_N} || 'From: Ada Doe <ada@example.com>' || {BS_N} ||
        'To: Support <help@example.com>' || {BS_N} || 'Customer: > an earlier line' || {BS_N} || body || {BS_N} || 'On Monday Ada wrote:' ||
        {BS_N} || '> another one' || {BS_N} || 'Best regards, Ada Doe' || {BS_N} || 'Support: Hello Ada, ' || answer || {BS_N} || '-- ' || {BS_N} ||
        'Support team' || {BS_N} || 'This message is confidential.' || {BS_N} || 'Customer: ' || doc_source || ' asks again' || {BS_N} ||
        'Thanks, but From: here on it is new' || {BS_N} || 'Thank you,' || {BS_N} || 'Ada' || {Q} AS email
        FROM fields WHERE lang IN ('fr', 'es')""",
    "raw_calls": """SELECT *, 'Customer: ' || subject || chr(10) || 'To: ' || doc_source || chr(10) || 'Customer: ' || body || chr(10) || 'Agent: ' || answer AS transcripts
        FROM fields WHERE lang = 'de'""",
    "raw_chats": f"""SELECT conv_id,
        {Q} || string_agg(CASE role WHEN 'user' THEN 'Customer' ELSE 'Agent' END || ': ' || text, {BS_N} ORDER BY turn) || {Q} AS chat,
        string_agg({stripped('text')}, ' ' ORDER BY turn) FILTER (role = 'user') AS asked,
        arg_min({stripped('text')}, turn) FILTER (role = 'user') AS first_asked,
        string_agg({stripped('text')}, ' ' ORDER BY turn) FILTER (role = 'assistant') AS replied
        FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY ALL""",
    "rec_forms": """SELECT 'form' AS source, md5(concat_ws(chr(31), coalesce(subject, chr(0)), coalesce(body, chr(0)),
        coalesce(answer, chr(0)), coalesce(type, chr(0)), coalesce(priority, chr(0)))) AS source_key,
        subject, body, answer, type, priority FROM raw_forms""",
    "email_parts": f"""SELECT *, CASE WHEN {stripped('body')} <> '' THEN {stripped('body')} || ' ' ELSE '' END || doc_source || ' asks again' || chr(10) ||
        'Thanks, but From: here on it is new' AS asked FROM raw_emails""",
    "rec_emails": f"SELECT {record('email', 'email', stripped('subject'), 'asked', stripped('answer'))} FROM email_parts",
    "call_parts": f"SELECT transcripts, {stripped("subject || chr(10) || 'To: ' || doc_source")} AS s, {stripped('body')} AS b, {stripped('answer')} AS an FROM raw_calls",
    "rec_calls": f"SELECT {record('transcripts', 'call', sentence('s'), "array_to_string(list_filter([s, b], lambda x: x <> ''), ' ')", 'an')} FROM call_parts",
    "rec_chats": f"SELECT {record('chat', 'chat', sentence('first_asked'), 'asked', 'replied')} FROM raw_chats",
    "unified": """SELECT * FROM (SELECT * FROM rec_forms UNION ALL SELECT * FROM rec_chats UNION ALL SELECT * FROM rec_emails
        UNION ALL SELECT * FROM rec_calls) WHERE subject <> '' AND body <> '' AND answer <> ''""",
    "tickets": "SELECT row_number() OVER (ORDER BY source, source_key) AS ticket_id, * FROM unified",
    "texts": "SELECT *, coalesce(subject || ' ' || body, body, subject, '') AS text FROM tickets",
    "tokened": f"SELECT *, {tokens('text')} AS tok FROM texts",
    "scored": f"""SELECT *, CASE WHEN bad > good THEN 'Negative' WHEN good > bad THEN 'Positive' ELSE 'Neutral' END AS sentiment,
        CASE WHEN {stripped('text')} <> '' THEN least(1.0::DOUBLE, 0.2::DOUBLE * bad) END AS churn
        FROM (SELECT *, {hits('tok', lexicons.NEGATIVE)} AS bad, {hits('tok', lexicons.POSITIVE)} AS good FROM tokened)""",
    "risks": """SELECT *, CASE WHEN churn IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, churn)) END AS risk FROM scored""",
    "products": """SELECT 'P' || CAST(doc_id AS VARCHAR) AS product_id, nullif(subject, '') AS title, nullif(body, '') AS description,
        CASE WHEN lang = 'de' THEN '' WHEN lang <> 'fr' THEN doc_source || '.jpg' END AS image,
        CASE WHEN lang = 'es' THEN 'gs://catalogue/' || CAST(doc_id AS VARCHAR) || '.png' END AS uri,
        CASE WHEN lang = 'es' AND n_chars < 500 THEN ['', '   ', NULL, chr(9)]
             WHEN lang = 'de' THEN ['', '   ', NULL, chr(9)] || lines
             WHEN lang = 'fr' AND n_chars < 500 THEN NULL ELSE lines END AS customer_comments FROM fields""",
    "commented": f"""SELECT product_id, comments, array_to_string(comments, chr(10)) AS comments_text FROM (
        SELECT product_id, list_filter(list_transform(customer_comments, lambda c: {stripped('c')}), lambda c: c IS NOT NULL AND length(c) > 0)
        AS comments FROM products) WHERE len(comments) > 0""",
    "scored_products": f"""SELECT *, {hits('tok', lexicons.ABUSIVE)} > 0 AS abusive, good >= bad AND good > 0 AS satisfied FROM (
        SELECT *, {hits('tok', lexicons.NEGATIVE)} AS bad, {hits('tok', lexicons.POSITIVE)} AS good FROM (
        SELECT *, {tokens('comments_text')} AS tok FROM commented))""",
    "images": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label FROM embeddings",
    **vectors("ticket_vecs", "tickets", "ticket_id", "coalesce(subject, '') || ' ' || coalesce(body, '')"),
    **vectors("email_vecs", "tickets WHERE source = 'email'", "ticket_id", "coalesce(subject, '') || ' ' || coalesce(body, '')"),
    **vectors("product_vecs", "products", "product_id", "coalesce(title, '') || ' ' || coalesce(description, '')"),
    **vectors("issue_vecs", "benchmark", "item_id", "text"),
    **nearest("near_products", "product_vecs", "issue_vecs", 9),
    **nearest("near_tickets", "ticket_vecs", "issue_vecs", 5),
    **nearest("near_emails", "email_vecs", "issue_vecs", 3),
    **nearest("near_images", "images", "images", 10),
    **nearest("cosine_images", "images", "images", 10, "1 - list_cosine_similarity(q.vec, b.vec)"),
    **nearest("dot_images", "images", "images", 10, "-list_inner_product(q.vec, b.vec)"),
    "pivots": "SELECT id AS p_id, vec FROM images ORDER BY id LIMIT 32",
    "gaps": """SELECT i.id, p_id, row_number() OVER (PARTITION BY i.id ORDER BY round(list_distance(i.vec, p.vec), 9), p_id) AS near
        FROM images i, pivots p""",
    "probed": """SELECT query_id, base_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, base_id) AS rank
        FROM near_images_p n JOIN gaps b ON b.id = base_id AND b.near = 1 JOIN gaps q ON q.id = query_id AND q.near <= 8 AND q.p_id = b.p_id""",
    "vec_nodes": "SELECT min(id) AS id, vec FROM ticket_vecs GROUP BY vec",
    **nearest("near_nodes", "vec_nodes", "vec_nodes", 6, "1 - list_cosine_similarity(q.vec, b.vec)"),
    "near_edges": "SELECT query_id AS a, base_id AS b, CAST(floor((1 - distance) * 1000) AS BIGINT) AS w FROM near_nodes WHERE query_id <> base_id",
    "node_edges": "SELECT a, b, max(w) AS w FROM (SELECT a, b, w FROM near_edges UNION ALL SELECT b, a, w FROM near_edges) WHERE w > 0 GROUP BY a, b",
    "node_members": "SELECT v.id AS ticket_id, n.id AS node FROM ticket_vecs v JOIN vec_nodes n USING (vec)",
    **spread("types", "nullif(type, '')"),
    **spread("priorities", "CASE WHEN lower(trim(priority)) IN ('high', 'urgent', 'p1', 'critical') THEN 'high' WHEN lower(trim(priority)) IN ('medium', 'low') THEN lower(trim(priority)) END"),
    **sparse("doc_features", "documents", "doc_id", "text"),
    **sparse("comment_features", "commented", "product_id", "comments_text"),
    **logistic("toxic_model", "toxic"),
    **logistic("quality_model", "quality"),
    "bucket_weights": """SELECT b, ln((SELECT count(DISTINCT id) + 1 FROM product_vecs_c)::DOUBLE / (count(*) + 1)) AS w
        FROM product_vecs_c GROUP BY b""",
    "weighted": "SELECT id, b, c * w AS x FROM product_vecs_c JOIN bucket_weights USING (b)",
    "tfidf": f"""SELECT id, list_transform(range({DIM}), lambda i: coalesce(m[i], 0) / norm) AS vec
        FROM (SELECT id, sqrt(sum(x * x)) AS norm, map(list(b), list(x)) AS m FROM weighted GROUP BY id) WHERE norm > 0""",
    "doc_words": f"SELECT doc_id, unnest({tokens('text')}) AS w FROM documents",
    "taught": "SELECT doc_id, toxic FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0 AND toxic IS NOT NULL AND text IS NOT NULL",
    "word_counts": "SELECT w, sum(toxic) AS bad, sum(1 - toxic) AS good FROM doc_words JOIN taught USING (doc_id) GROUP BY w",
    "word_weights": """SELECT w, ln((bad + 1) / (SELECT sum(bad) + count(*) FROM word_counts)::DOUBLE)
        - ln((good + 1) / (SELECT sum(good) + count(*) FROM word_counts)::DOUBLE) AS weight FROM word_counts""",
    "word_totals": "SELECT doc_id, sum(weight) AS total FROM doc_words JOIN word_weights USING (w) GROUP BY doc_id",
    "mail_lines": """SELECT doc_id, source, lang, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS place
        FROM documents""",
    "marked_lines": r"""SELECT *, CASE WHEN length(regexp_replace(line, '[^\p{L}\p{N}]+', '', 'g')) >= 8
        THEN trim(lower(regexp_replace(regexp_replace(line, '^[>\s]+', ''), '\s+', ' ', 'g'))) END AS mark FROM mail_lines""",
    "often_lines": "SELECT lang, mark FROM marked_lines WHERE mark IS NOT NULL AND lang IS NOT NULL GROUP BY lang, mark HAVING count(DISTINCT doc_id) >= 3",
    "first_lines": "SELECT source, mark, min(doc_id) AS first_id FROM marked_lines WHERE mark IS NOT NULL AND source IS NOT NULL GROUP BY source, mark",
    "judged_lines": """SELECT m.*, o.mark IS NOT NULL AS often, coalesce(first_id < doc_id, false) AS quoted FROM marked_lines m
        LEFT JOIN often_lines o ON o.lang = m.lang AND o.mark = m.mark LEFT JOIN first_lines f ON f.source = m.source AND f.mark = m.mark""",
    "near_answers": f"""SELECT query_id, rank, answer, list_distinct({tokens('answer')}) AS w FROM near_tickets JOIN tickets ON base_id = ticket_id
        WHERE {stripped('answer')} <> ''""",
    "answer_gaps": """SELECT a.query_id, a.rank, any_value(a.answer) AS answer, count(*) AS n,
        round(sum(coalesce(1 - len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0)::DOUBLE, 0)), 9) AS total,
        count_if(coalesce(1 - len(list_intersect(a.w, b.w)) / nullif(len(list_distinct(a.w || b.w)), 0)::DOUBLE, 0) <= 0.9) - 1 AS near
        FROM near_answers a JOIN near_answers b ON a.query_id = b.query_id GROUP BY a.query_id, a.rank""",
    "middle_answers": """SELECT query_id, answer, coalesce(near / nullif(n - 1, 0)::DOUBLE, 1) AS agreement
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total, rank) AS place FROM answer_gaps) WHERE place = 1""",
    "rated": "SELECT doc_id, quality = 0 AS gone FROM labels JOIN documents USING (doc_id) WHERE doc_id % 5 <> 0 AND quality IS NOT NULL AND text IS NOT NULL",
    "rated_words": "SELECT w, count_if(gone) AS n_cue, count_if(NOT gone) AS n_other FROM doc_words JOIN rated USING (doc_id) GROUP BY w",
    "rated_sums": "SELECT sum(n_cue)::DOUBLE AS a, sum(n_other)::DOUBLE AS b FROM rated_words",
    "cue_hits": """SELECT w, n_cue, n_other, a, b, n_cue + 1000.0::DOUBLE * (n_cue + n_other) / (a + b) AS x,
        n_other + 1000.0::DOUBLE * (n_cue + n_other) / (a + b) AS y FROM rated_words, rated_sums""",
    "cues": "SELECT *, ln(x / (a + 1000 - x)) - ln(y / (b + 1000 - y)) AS weight, sqrt(1 / x + 1 / y) AS spread FROM cue_hits",
    "strong_cues": "SELECT w, weight FROM cues WHERE weight / spread >= 1.96::DOUBLE",
    "rated_density": """SELECT r.doc_id, any_value(gone) AS gone, sum(coalesce(weight, 0)) / count(*) AS density
        FROM rated r JOIN doc_words USING (doc_id) LEFT JOIN strong_cues USING (w) GROUP BY r.doc_id""",
    "density_bins": "SELECT least(greatest(CAST(floor(density / 0.05::DOUBLE) AS BIGINT), 0), 63) AS bin, count(*) AS n, count_if(gone) AS hits FROM rated_density GROUP BY bin",
    "all_bins": "SELECT i AS bin, coalesce(n, 0) AS n, coalesce(hits, 0) AS hits FROM range(64) r(i) LEFT JOIN density_bins ON bin = i",
    "stretches": """SELECT a.bin AS lo, b.bin AS hi, (SELECT sum(hits) / nullif(sum(n), 0)::DOUBLE FROM all_bins m WHERE m.bin BETWEEN a.bin AND b.bin) AS mean
        FROM all_bins a JOIN all_bins b ON a.bin <= b.bin""",
    "least_means": "SELECT i.bin, lo, min(mean) AS mean FROM all_bins i JOIN stretches ON lo <= i.bin AND hi >= i.bin GROUP BY i.bin, lo",
    "risk_bins": "SELECT bin, max(value) OVER (ORDER BY bin) AS risk FROM (SELECT bin, coalesce(max(mean), 0) AS value FROM least_means GROUP BY bin)",
    "ticket_density": """SELECT ticket_id, sum(coalesce(weight, 0)) / count(*) AS density FROM (SELECT ticket_id, unnest(tok) AS w FROM tokened)
        LEFT JOIN strong_cues USING (w) GROUP BY ticket_id""",
    "placed": f"SELECT doc_id, tok, unnest(range(1, len(tok) + 1)) AS i FROM (SELECT doc_id, {tokens('text')} AS tok FROM documents)",
    "positions": "SELECT doc_id, i, tok[i] AS w, least(i - 1, 4) + least(len(tok) - i, 4) AS pairs FROM placed WHERE len(tok) > 1",
    "seed_hits": f"""SELECT p.w, count_if(s.w IN {words(lexicons.POSITIVE)}) AS p, count_if(s.w IN {words(lexicons.NEGATIVE)}) AS q FROM positions p
        JOIN positions s ON p.doc_id = s.doc_id AND s.i BETWEEN p.i - 4 AND p.i + 4 AND s.i <> p.i AND s.w IN {words((*lexicons.POSITIVE, *lexicons.NEGATIVE))} GROUP BY p.w""",
    "pair_counts": """SELECT w, CAST(n AS BIGINT) AS n, CAST(coalesce(p, 0) AS BIGINT) AS p, CAST(coalesce(q, 0) AS BIGINT) AS q FROM (SELECT w, sum(pairs) AS n FROM positions GROUP BY w)
        LEFT JOIN seed_hits USING (w)""",
    "pair_sums": "SELECT sum(n)::DOUBLE AS n_all, sum(p)::DOUBLE AS p_all, sum(q)::DOUBLE AS q_all FROM pair_counts",
    "polarity": """SELECT w, n, p, q, CASE WHEN p > 0 THEN greatest(0, ln(p * n_all / (n * p_all))) ELSE 0 END
        - CASE WHEN q > 0 THEN greatest(0, ln(q * n_all / (n * q_all))) ELSE 0 END AS weight FROM pair_counts, pair_sums""",
    "seed_words": " UNION ALL ".join(f"SELECT {quoted(w)} AS w, {side} AS seed" for side, found in ((1, lexicons.POSITIVE), (-1, lexicons.NEGATIVE)) for w in found),
    "known_polarity": """SELECT coalesce(f.w, s.w) AS w, CASE WHEN seed > 0 THEN greatest(coalesce(weight, 1), 1) WHEN seed < 0 THEN least(coalesce(weight, -1), -1)
        ELSE weight END AS weight FROM (SELECT w, weight FROM polarity WHERE n >= 40 AND weight <> 0) f FULL JOIN seed_words s ON f.w = s.w""",
    "ticket_moods": """SELECT ticket_id, round(sum(weight), 9) AS total FROM (SELECT ticket_id, unnest(tok) AS w FROM tokened) JOIN known_polarity USING (w) GROUP BY ticket_id""",
}


def with_tables(select: str) -> str:
    """``select`` preceded by the CTEs it needs, directly or through others."""
    names = list(CTES)

    def used(sql: str) -> set[str]:
        return {name for name in names if re.search(rf"\b{name}\b", sql)}

    needed: set[str] = set()
    todo = used(select)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo |= used(CTES[name]) - needed
    ctes = ", ".join(f"{name} AS ({CTES[name]})" for name in names if name in needed)
    return (f"WITH {ctes} " if ctes else "") + select


def counts(key: str, name: str, table: str) -> str:
    return f"SELECT {key} AS {name}, count(*) AS cnt FROM {table} GROUP BY ALL"


def rate(flag: str, hit: str, total: str, ratio: str, table: str) -> str:
    return f"""SELECT CAST(sum(CASE WHEN {flag} THEN 1 ELSE 0 END) AS BIGINT) AS {hit}, count(*) AS {total},
        sum(CASE WHEN {flag} THEN 1 ELSE 0 END) / nullif(count(*), 0)::DOUBLE AS {ratio} FROM {table}"""


def prior_tickets(instruction: str) -> str:
    return f"""SELECT i.item_id AS query_id,
        {quoted(instruction)} || chr(10) || chr(10) || 'Issue:' || chr(10) || coalesce(i.text, '') || chr(10) || chr(10) ||
        'Earlier tickets:' || chr(10) || coalesce(n.prior, '') AS prompt
        FROM benchmark i LEFT JOIN (SELECT query_id, string_agg(rank || '. subject: ' || subject || chr(10) || '  body: ' || body ||
        chr(10) || '  answer: ' || answer, chr(10) ORDER BY rank) AS prior
        FROM near_tickets JOIN tickets ON base_id = ticket_id GROUP BY query_id) n ON n.query_id = i.item_id"""


SPOKEN = """'Customer: Hello, a file of ' || strlen(html) || ' bytes came. What now?' || chr(10) || 'Agent: Hi, keep all ' || strlen(html) || ' bytes.'"""
PRIORITY = "nullif(lower(split_part(o_orderpriority, '-', 2)), 'not specified')"
TYPE = "nullif(p_type, 'ECONOMY')"
SCALED = "CASE WHEN event_type <> 'error' THEN (value - 50) / 100 END"

SELECTS: dict[str, str] = {
    "priority_distribution": f"""SELECT priority, cnt, cnt / CAST(sum(cnt) OVER () AS DOUBLE) AS pct
        FROM ({counts(f"coalesce({PRIORITY}, 'unknown')", 'priority', 'orders')})""",
    "type_top5": counts(f"coalesce({TYPE}, 'unknown')", "type", "part") + " ORDER BY cnt DESC, type LIMIT 5",
    "ticket_priority_distribution": f"""SELECT priority, cnt, cnt / CAST(sum(cnt) OVER () AS DOUBLE) AS pct
        FROM ({counts("coalesce(priority, 'unknown')", 'priority', 'tickets')})""",
    "ticket_type_top5": counts("coalesce(type, 'unknown')", "type", "tickets") + " ORDER BY cnt DESC, type LIMIT 5",
    "ticket_text": """SELECT doc_id, coalesce(s || ' ' || b, b, s, '') AS text FROM (
        SELECT doc_id, nullif(subject, answer) AS s, nullif(body, '') AS b FROM fields)""",
    "product_comments": "SELECT product_id, len(comments) AS n_comments, comments_text FROM commented",
    "clamp_risk": f"""SELECT event_id, CASE WHEN x IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, x)) END AS risk
        FROM (SELECT event_id, {SCALED} AS x FROM events)""",
    "product_cards": """SELECT product_id, coalesce(title, '') AS title,
        CASE WHEN length(d) > 200 THEN substr(d, 1, 200) || '…' ELSE d END AS preview,
        regexp_replace(uri, '^gs://', 'https://storage.googleapis.com/') AS image_url
        FROM (SELECT *, coalesce(description, '') AS d FROM products)""",
    "fill_uri": """SELECT product_id, CASE WHEN uri IS NULL AND image IS NOT NULL AND image <> ''
        THEN 'gs://catalogue/images/' || image ELSE uri END AS uri FROM products""",
    "add_column_if_missing": "SELECT p_partkey, p_type, CAST(NULL AS VARCHAR) AS uri FROM part",
    "keyed_update": """SELECT c_custkey, c_name, CASE WHEN o_custkey IS NOT NULL THEN price ELSE c_acctbal END AS c_acctbal
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "redact_pii": f"SELECT doc_id, {redacted('text')} AS text FROM documents",
    "classify_type": f"SELECT doc_id, {first_rule('text', lexicons.TYPES, 'Other')} AS type FROM documents",
    "classify_priority": f"SELECT doc_id, {first_rule('text', lexicons.PRIORITIES, 'low')} AS priority FROM documents",
    "assemble_transcripts": """SELECT conv_id,
        string_agg(CASE role WHEN 'user' THEN 'Customer' ELSE 'Agent' END || ': ' || text, chr(10) ORDER BY turn) AS transcripts
        FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL GROUP BY ALL""",
    "normalize_chats": "SELECT * FROM rec_chats",
    "normalize_emails": "SELECT * FROM rec_emails",
    "normalize_calls": "SELECT * FROM rec_calls",
    "tickets_unified": "SELECT * FROM unified",
    "dense_ticket_id": "SELECT ticket_id, source, source_key FROM tickets",
    "scoring_prompts": f"""SELECT ticket_id, {quoted(prompts.SENTIMENT)} || text AS sentiment_prompt,
        {quoted(prompts.CHURN)} || text AS churn_prompt FROM texts""",
    "comment_prompts": f"""SELECT product_id, {quoted(prompts.ABUSE)} || comments_text AS abuse_prompt,
        {quoted(prompts.SATISFACTION)} || comments_text AS satisfaction_prompt FROM commented""",
    "extraction_prompts": " UNION ALL ".join(
        f"SELECT '{kind}' AS source, md5({raw}) AS source_key, {quoted(prompts.RecordRules().instruction(kind))} || {raw} AS prompt FROM raw_{kind}s"
        for kind, raw in (("chat", "chat"), ("email", "email"), ("call", "transcripts"))
    ),
    "score_sentiment": "SELECT ticket_id, sentiment FROM scored",
    "score_churn": "SELECT ticket_id, churn FROM scored",
    "score_abuse": "SELECT product_id, abusive FROM scored_products",
    "score_satisfaction": "SELECT product_id, satisfied FROM scored_products",
    "score_store": "SELECT ticket_id, sentiment, churn FROM scored",
    "score_abuse_logistic": f"""SELECT doc_id, round(1 / (1 + exp(-coalesce(logit, 0) - (SELECT w FROM toxic_model WHERE b = -1))), 6) AS score,
        doc_id % 5 = 0 AS held_out FROM documents LEFT JOIN {probability('toxic_model', 'doc_features')} ON id = doc_id""",
    "score_satisfaction_logistic": f"""SELECT product_id, round(1 / (1 + exp(-coalesce(logit, 0) - (SELECT w FROM quality_model WHERE b = -1))), 6) AS score
        FROM commented LEFT JOIN {probability('quality_model', 'comment_features')} ON id = product_id""",
    "churn_weights": "SELECT w AS word, CAST(n_cue AS BIGINT) AS n_cue, CAST(n_other AS BIGINT) AS n_other, round(weight, 6) AS weight, round(weight / spread, 6) AS z FROM cues",
    "score_churn_weighted": """SELECT t.ticket_id, round(risk, 6) AS churn FROM tickets t LEFT JOIN ticket_density USING (ticket_id)
        LEFT JOIN risk_bins ON bin = least(greatest(CAST(floor(density / 0.05::DOUBLE) AS BIGINT), 0), 63)""",
    "induced_polarity": "SELECT w AS word, n, p AS near_positive, q AS near_negative, round(weight, 6) AS weight FROM polarity",
    "score_sentiment_induced": """SELECT t.ticket_id, CASE WHEN total > 0 THEN 'Positive' WHEN total < 0 THEN 'Negative' ELSE 'Neutral' END AS sentiment
        FROM tickets t LEFT JOIN ticket_moods USING (ticket_id)""",
    "keyed_update_buckets": """SELECT c_custkey, c_name, CASE WHEN o_custkey IS NOT NULL THEN price ELSE c_acctbal END AS c_acctbal
        FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS price FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey) ON o_custkey = c_custkey""",
    "append_ticket_ids": """SELECT row_number() OVER (ORDER BY CASE WHEN source IN ('form', 'chat') THEN 0 ELSE 1 END, source, source_key) AS ticket_id, source, source_key
        FROM (SELECT DISTINCT source, source_key FROM unified)""",
    "thread_repeats": f"""SELECT doc_id, {stripped("coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT often AND NOT quoted), '')")} AS text,
        CAST(count_if(often) AS BIGINT) AS n_boilerplate, CAST(count_if(quoted) AS BIGINT) AS n_quoted FROM judged_lines GROUP BY doc_id""",
    "agreed_answer": f"""SELECT item_id AS query_id, CASE WHEN coalesce(agreement, 0) >= 0.25 THEN answer ELSE {quoted(CONTACT.message())} END AS reply,
        round(coalesce(agreement, 0), 6) AS agreement, coalesce(agreement, 0) < 0.25 AS asked FROM benchmark LEFT JOIN middle_answers ON query_id = item_id""",
    "propagate_types": """SELECT ticket_id, CASE WHEN score >= 100000 THEN label ELSE 'Other' END AS type, coalesce(score, 0) AS score
        FROM tickets LEFT JOIN node_members USING (ticket_id) LEFT JOIN types USING (node)""",
    "propagate_priorities": """SELECT ticket_id, CASE WHEN score >= 200000 THEN label ELSE 'low' END AS priority, coalesce(score, 0) AS score
        FROM tickets LEFT JOIN node_members USING (ticket_id) LEFT JOIN priorities USING (node)""",
    "kpis_tickets": """SELECT count(*) AS total_tickets, count_if(lower(coalesce(sentiment, 'unknown')) = 'negative') / count(*)::DOUBLE
        AS negative_rate, CAST(count_if(lower(coalesce(priority, 'unknown')) IN ('high', 'urgent', 'p1', 'critical')) AS BIGINT)
        AS urgent_count FROM scored""",
    "dist_sentiment": counts("coalesce(sentiment, 'unknown')", "sentiment", "scored"),
    "churn_kpis": """SELECT round(avg(risk), 6) AS avg_risk, quantile_disc(risk, 0.9) AS p90_risk,
        CAST(sum(CASE WHEN risk >= 0.7 THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count, count(*) AS total_tickets FROM risks""",
    "churn_distribution": counts(
        """CASE WHEN risk < 0.2::DOUBLE THEN '[0.0–0.2)' WHEN risk < 0.4::DOUBLE THEN '[0.2–0.4)'
        WHEN risk < 0.6::DOUBLE THEN '[0.4–0.6)' WHEN risk < 0.8::DOUBLE THEN '[0.6–0.8)' ELSE '[0.8–1.0]' END""",
        "bucket_label", "risks",
    ),
    "churn_top": """SELECT ticket_id, risk, round_even(risk * 100, 1) AS risk_pct, substr(text, 1, 200) AS snippet FROM risks
        ORDER BY risk DESC NULLS LAST, ticket_id LIMIT 20""",
    "kpis_abuse": rate("abusive", "abusive_count", "total_with_comments", "abuse_rate", "scored_products"),
    "abuse_distribution": """SELECT abusive, cnt, CASE WHEN abusive THEN 'Abusive' WHEN NOT abusive THEN 'Clean' END AS label
        FROM (SELECT abusive, count(*) AS cnt FROM scored_products GROUP BY abusive)""",
    "abusive_examples": """SELECT product_id, substr(array_to_string(comments, ' | '), 1, 300) AS comment_snippet, abusive
        FROM scored_products WHERE abusive ORDER BY product_id LIMIT 20""",
    "satisfaction_kpis": rate("satisfied", "satisfied_count", "total_scored", "satisfaction_rate", "scored_products"),
    "satisfaction_distribution": "SELECT satisfied, count(*) AS cnt FROM scored_products GROUP BY satisfied",
    "label_distribution": """SELECT satisfied, cnt, CASE WHEN satisfied THEN 'Satisfied' WHEN NOT satisfied THEN 'Not satisfied' END AS label
        FROM (SELECT satisfied, count(*) AS cnt FROM scored_products GROUP BY satisfied)""",
    "embed_tickets": f"SELECT ticket_id, {vector_code('vec')} AS vector FROM tickets LEFT JOIN ticket_vecs ON id = ticket_id",
    "embed_products": f"SELECT p.product_id, {vector_code('vec')} AS vector FROM products p LEFT JOIN product_vecs ON id = p.product_id",
    "embed_queries": f"SELECT item_id, {vector_code('vec')} AS vector FROM benchmark LEFT JOIN issue_vecs ON id = item_id",
    "embed_missing": f"""SELECT p.product_id, {vector_code('coalesce(i.vec, v.vec)')} AS vector FROM products p
        LEFT JOIN images i ON 'P' || CAST(i.id AS VARCHAR) = p.product_id LEFT JOIN product_vecs v ON v.id = p.product_id""",
    "vector_topk_single": """SELECT b.id AS vec_id, round(list_distance(c.vec, b.vec), 6) AS distance FROM images b, (
        SELECT list(x ORDER BY i) AS vec FROM (SELECT i, avg(vec[i]) AS x FROM images, range(1, 65) AS r(i) GROUP BY i)) c
        ORDER BY round(list_distance(c.vec, b.vec), 12), b.id LIMIT 9""",
    "vector_topk_batch": "SELECT query_id, base_id, rank, round(distance, 6) AS distance FROM near_images",
    "vector_topk_cells": "SELECT query_id, base_id, rank, round(distance, 6) AS distance FROM near_images",
    "vector_topk_ivf": """SELECT query_id, base_id, p.rank, round(p.distance, 6) AS distance, recall FROM probed p JOIN (
        SELECT query_id, count(p.base_id) / count(*)::DOUBLE AS recall FROM near_images n
        LEFT JOIN (SELECT * FROM probed WHERE rank <= 10) p USING (query_id, base_id) GROUP BY query_id) USING (query_id) WHERE p.rank <= 10""",
    **{
        f"vector_topk_{metric}{plan}": f"SELECT query_id, base_id, rank, round(distance, 6) AS distance FROM {metric}_images"
        for metric in ("cosine", "dot")
        for plan in ("", "_cells")
    },
    "quantized_recall": "SELECT count(DISTINCT query_id) AS n_queries, count(*) AS n_neighbours, true AS reached FROM near_images",
    "embed_tfidf_products": """SELECT p.product_id, array_to_string(list_transform(vec, lambda x: CAST(CAST(round(x * 100000) AS BIGINT) AS VARCHAR)), ',')
        AS vector FROM products p LEFT JOIN tfidf ON id = p.product_id""",
    "train_abuse_model": """SELECT doc_id, round(coalesce(total, 0) + (SELECT ln((sum(toxic) + 1) / (sum(1 - toxic) + 1)::DOUBLE) FROM taught), 6) > 0 AS abusive,
        doc_id % 5 = 0 AS held_out FROM documents LEFT JOIN word_totals USING (doc_id)""",
    "list_objects": "SELECT CAST(page_id % 10 AS INTEGER) AS digit, true AS listed, CAST(sum(strlen(html) + 1) AS BIGINT) AS n_bytes FROM pages GROUP BY page_id % 10",
    "redact_names_learned": """SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN CASE c_custkey % 3 WHEN 0 THEN 'Dr. ' WHEN 1 THEN 'Mrs ' ELSE 'Mr. ' END
        || '[NAME] asked about an order from ' || nation || '.' || chr(10) ELSE '' END ||
        CASE WHEN c_custkey % 2 = 0 THEN 'please call [NAME] back today.' ELSE '[NAME] wants the invoice for ' || nation || '.' END AS text
        FROM customer JOIN (SELECT n_nationkey, list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), 'string_agg', ' ') AS nation
        FROM nation) ON n_nationkey = c_nationkey""",
    "create_or_replace": "SELECT n_nationkey, lower(n_name) AS n_name FROM nation",
    "load_forms": """SELECT nullif(subject, '') AS subject, nullif(body, '') AS body, nullif(answer, '') AS answer, type, priority
        FROM raw_forms""",
    "load_chats": "SELECT chat FROM raw_chats",
    "load_products": """SELECT product_id, title, description, image, len(customer_comments) AS n_comments,
        array_to_string(customer_comments, '|') AS comments FROM products""",
    "build_products_images": """SELECT product_id, CASE WHEN url IS NOT NULL THEN url WHEN uri IS NULL AND image IS NOT NULL AND image <> ''
        THEN 'gs://catalogue/' || image ELSE uri END AS uri, strlen(html) AS n_bytes, CAST(ascii(html) AS BIGINT) AS first_byte
        FROM products LEFT JOIN pages ON product_id = 'P' || CAST(page_id AS VARCHAR)""",
    "embed_image": "SELECT url AS path, strlen(html) AS n_bytes FROM pages",
    "transcribe_calls": f"SELECT url AS path, {SPOKEN} AS transcripts FROM pages",
    "build_tickets_from_objects": f"""SELECT row_number() OVER (ORDER BY md5({SPOKEN})) AS ticket_id, 'call' AS source, md5({SPOKEN}) AS source_key,
        'a file of ' || strlen(html) || ' bytes came.' AS subject, 'a file of ' || strlen(html) || ' bytes came. What now?' AS body,
        'keep all ' || strlen(html) || ' bytes.' AS answer, 'Other' AS type, 'low' AS priority, 64::BIGINT AS dim FROM pages""",
    "vector_topk_filtered": """SELECT query_id, ticket_id, rank, round(distance, 6) AS distance, subject, answer
        FROM near_emails JOIN tickets ON base_id = ticket_id""",
    "search_products": """SELECT query_id, product_id, rank, round(distance, 6) AS distance, title, uri
        FROM near_products JOIN products ON base_id = product_id""",
    "search_tickets": """SELECT query_id, ticket_id, rank, round(distance, 6) AS distance, source, type, priority, subject
        FROM near_tickets JOIN tickets ON base_id = ticket_id""",
    "reply_prompts": prior_tickets(replies.AGENT_INSTRUCTION),
    "help_prompts": prior_tickets(replies.help_instruction(CONTACT)),
    "answer_or_route": f"""SELECT i.item_id AS query_id, coalesce(r.reply, {quoted(CONTACT.message())}) AS reply,
        r.reply IS NULL AS routed FROM benchmark i LEFT JOIN (SELECT query_id, nullif({stripped('answer')}, '') AS reply
        FROM near_tickets JOIN tickets ON base_id = ticket_id WHERE rank = 1 AND distance <= 0.7) r ON NOT contains(lower(i.text), ' the ') AND r.query_id = i.item_id""",
}
SELECTS["churn_kpis_merged"] = SELECTS["churn_kpis"]
SELECTS["kpis_display"] = SELECTS["kpis_tickets"]


def oracle_sql() -> dict[str, str]:
    return {name: with_tables(select) for name, select in SELECTS.items()}
