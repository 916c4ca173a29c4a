"""The registered queries that SQL can express, stated in SQL for another engine."""

from __future__ import annotations

from hindcast.llm import conversation_repair, curriculum, filter_audit, host_quality, pii, warc_index
from hindcast.llm.queries import LINKS, URL_RULES

SPACED = "[^\\x20\\x09-\\x0D]+"
ALPHANUMERIC = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _host_quality() -> str:
    rules = host_quality.RULES
    low, high = host_quality.STRENGTH
    rates = ", ".join(f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS {r}_f" for r, test in rules.items())
    prior = ", ".join(f"avg({r}_f / documents) AS {r}_m, var_pop({r}_f / documents) AS {r}_v" for r in rules)

    def shrunk(r):
        strength = f"greatest({low}, least({high}, CASE WHEN {r}_v > 0 THEN {r}_m * (1 - {r}_m) / {r}_v - 1 ELSE {high} END))"
        return f"({r}_f + {r}_m * {strength}) / (documents + {strength})"

    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(text, '') AS text FROM documents),
    words AS (SELECT id, regexp_extract_all(text, '{SPACED}') AS w FROM docs),
    places AS (SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5),
    grams AS (SELECT id, i, md5(concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4])) AS gram FROM places),
    again AS (SELECT id, list(i) AS places FROM grams GROUP BY id, gram HAVING count(*) > 1),
    covered AS (SELECT id, count(DISTINCT i + k) AS n_repeat_words
                FROM (SELECT id, i, unnest(range(0, 5)) AS k FROM (SELECT id, unnest(places) AS i FROM again)) GROUP BY id),
    lines AS (SELECT id, unnest(string_split(text, chr(10))) AS line FROM docs),
    line_counts AS (SELECT id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
                    WHERE regexp_matches(line, '{SPACED}') GROUP BY id),
    measured AS (
        SELECT id, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
               CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
               CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
               CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
        FROM docs JOIN words USING (id) LEFT JOIN line_counts USING (id) LEFT JOIN covered USING (id)),
    hosts AS (SELECT source, count(*) AS documents, {rates} FROM measured GROUP BY source),
    prior AS (SELECT {prior} FROM hosts),
    verdicts AS (SELECT source, greatest({", ".join(shrunk(r) for r in rules)}) > {host_quality.HOST_LIMIT} AS host_rejected FROM hosts, prior)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
           NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT host_rejected AS kept, host_rejected
    FROM measured m JOIN verdicts v ON m.source IS NOT DISTINCT FROM v.source"""


def _warc_index() -> str:
    return f"""
    WITH rows AS (
        SELECT page_id, lower(regexp_replace(coalesce(url, ''), '#.*$', '')) AS u, coalesce(html, '') AS html FROM pages),
    parts AS (SELECT page_id, regexp_replace(u, '^[^:/?#]*://', '') AS rest, html, sha256(html) AS digest, strlen(html) AS n FROM rows),
    first AS (SELECT digest, min(page_id) AS page FROM parts WHERE n >= {warc_index.LEAST_BYTES} GROUP BY digest),
    keyed AS (
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, parts.digest AS payload_digest,
               CASE WHEN page_id > first.page THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first.page THEN first.page END AS refers_to,
               CASE WHEN rest = '' THEN '' ELSE
                   array_to_string(list_reverse(string_split(regexp_extract(rest, '^[^/?]*'), '.')), ',') || ')'
                   || substring(rest, length(regexp_extract(rest, '^[^/?]*')) + 1) END AS url_key,
               strftime(make_timestamp(({warc_index.EPOCH} + page_id) * 1000000), '%Y%m%d%H%M%S') AS capture_time
        FROM parts LEFT JOIN first USING (digest))
    SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY capture_time, page_id) AS capture_no FROM keyed"""


def _url_rules() -> str:
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    return f"""
    WITH rules AS (SELECT * FROM (VALUES {values}) AS t(verdict, host, path)),
    parts AS (
        SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
               regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    best AS (
        SELECT p.page_id, p.host, p.path, max_by(r.host || r.path, length(r.host || r.path)) AS rule,
               max_by(r.verdict, length(r.host || r.path)) AS verdict
        FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
        GROUP BY ALL)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best"""


def _decontaminate() -> str:
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, doc_id,
                         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALPHANUMERIC}') AS w FROM documents),
    items AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ALPHANUMERIC}') AS w
              FROM benchmark),
    windows AS (
        SELECT item, 10 AS size, array_to_string(w[i:i+9], ' ') AS gram
        FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM items WHERE len(w) >= 10)
        UNION SELECT item, len(w), array_to_string(w, ' ') FROM items WHERE len(w) BETWEEN 1 AND 9),
    sizes AS (SELECT DISTINCT size FROM windows),
    places AS (SELECT id, size, w, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes WHERE len(w) >= size),
    grams AS (SELECT id, size, i, array_to_string(w[i:i+size-1], ' ') AS gram FROM places),
    hits AS (SELECT id, size, i, item FROM grams JOIN windows USING (size, gram)),
    covered AS (SELECT id, count(DISTINCT k) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY id),
    named AS (SELECT id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS named FROM hits GROUP BY id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(named, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN covered USING (id) LEFT JOIN named USING (id)"""


def _jaccard_links() -> str:
    """The classes, with the documents that a document's class links to and its own copies counted."""
    return f"""
    WITH {_jaccard_ctes()},
    copies AS (SELECT node, count(*) AS documents FROM sets JOIN classes ON sets.s = classes.s GROUP BY node),
    degrees AS (SELECT a AS node, sum(documents) AS linked FROM both_ways JOIN copies ON copies.node = b GROUP BY a)
    SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
           CASE WHEN len(sets.s) = 0 THEN doc_id ELSE coalesce(component_id, classes.node) END AS component_id,
           CASE WHEN len(sets.s) = 0 THEN 0 ELSE CAST(documents - 1 + coalesce(linked, 0) AS BIGINT) END AS n_links
    FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN named USING (node) LEFT JOIN copies USING (node)
         LEFT JOIN degrees USING (node)"""


def _jaccard_ctes() -> str:
    """The common part of the two statements, as the first one has it."""
    whole = _jaccard_join()
    return whole[whole.index("WITH ") + len("WITH ") : whole.rindex("    SELECT doc_id")].rstrip()


def _jaccard_join() -> str:
    size, times, over = LINKS.words, LINKS.times, LINKS.over
    return f"""
    WITH RECURSIVE docs AS (SELECT row_number() OVER () AS id, doc_id,
                         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{SPACED}') AS w FROM documents),
    sets AS (
        SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
               ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {size} + 2), lambda i: array_to_string(w[i:i+{size - 1}], ' ')))) END AS s
        FROM docs),
    classes AS (SELECT min(doc_id) AS node, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
    tokens AS (SELECT node, n, unnest(s) AS t FROM classes),
    counted AS (SELECT t, count(*) AS df FROM tokens GROUP BY t HAVING count(*) > 1),
    ranked AS (SELECT node, n, t, row_number() OVER (PARTITION BY node ORDER BY coalesce(df, 1), t) AS place
               FROM tokens LEFT JOIN counted USING (t)),
    prefixes AS (SELECT node, n, t FROM ranked WHERE place <= n - CAST(ceil({times} * n / {over}) AS BIGINT) + 1),
    candidates AS (SELECT DISTINCT a.node AS a, b.node AS b FROM prefixes a JOIN prefixes b ON a.t = b.t AND a.node < b.node
                   WHERE {over} * least(a.n, b.n) >= {times} * greatest(a.n, b.n)),
    links AS (
        SELECT a, b FROM (SELECT a, b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS k
                          FROM candidates JOIN classes x ON x.node = a JOIN classes y ON y.node = b)
        WHERE {over} * k >= {times} * (total - k)),
    both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reached(node, other) AS (SELECT node, node FROM classes WHERE node IN (SELECT a FROM both_ways)
                             UNION SELECT reached.node, b FROM reached JOIN both_ways ON other = a),
    named AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
    SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles,
           CASE WHEN len(sets.s) = 0 THEN doc_id ELSE coalesce(component_id, classes.node) END AS component_id
    FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN named USING (node)"""


def _curriculum() -> str:
    n, repeats, share = len(curriculum.WEIGHTS), curriculum.MAX_REPEATS, curriculum.SHARE

    def choose(values):
        return f"CASE {' '.join(f'WHEN rank % {n} = {i} THEN {v}' for i, v in enumerate(values))} END"

    def number(x):
        return f"CAST('{x!r}' AS DOUBLE)"

    def time_of(knots):
        expression = None
        for p in reversed(curriculum.segments(knots)):
            left = f"(asked - {number(p.before)})"
            at = f"({number(p.start)} + {number(2.0)} * {left} / ({number(p.weight)} + sqrt({number(p.weight * p.weight)} + {number(2 * p.slope)} * {left})))"
            expression = at if expression is None else f"CASE WHEN asked <= {number(p.upto)} THEN {at} ELSE {expression} END"
        return expression

    def demand(knots):
        expression = None
        for p in reversed(curriculum.segments(knots)):
            dt = f"(t - {number(p.start)})"
            share_at = f"({number(p.before)} + {number(p.weight)} * {dt} + {number(p.slope / 2)} * {dt} * {dt})"
            expression = share_at if expression is None else f"CASE WHEN t <= {number(p.end)} THEN {share_at} ELSE {expression} END"
        return expression

    def taken(k):
        return f"greatest(0, least(size, CAST(floor(target) AS BIGINT) - start - {k} * source_size))"

    schedules = curriculum.SCHEDULES
    position = " + ".join([number(0.0), *(f"w{i} * {demand(s)}" for i, s in enumerate(schedules))])
    times = f"CASE {' '.join(f'WHEN rank % {len(schedules)} = {i} THEN {time_of(s)}' for i, s in enumerate(schedules))} END"
    turns = ", ".join(f"coalesce(sum(target) FILTER (rank % {len(schedules)} = {i}), 0) AS w{i}" for i in range(len(schedules)))
    return f"""
    WITH docs AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SPACED}')) AS size,
               md5('{curriculum.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
    sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM docs GROUP BY source),
    weighted AS (SELECT *, {choose(curriculum.WEIGHTS)} AS weight, {repeats} * source_size AS cap FROM sizes),
    filled AS (SELECT *, sum(cap) OVER o AS cap_sum, sum(weight) OVER o AS weight_sum, row_number() OVER (ORDER BY cap / weight, rank) AS place FROM weighted
               WINDOW o AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    units AS (SELECT *, ({share} * (SELECT sum(source_size) FROM sizes) - coalesce(cap_sum, 0)) / ((SELECT sum(weight) FROM weighted) - coalesce(weight_sum, 0)) AS unit FROM filled),
    unit AS (SELECT arg_min(unit, place) AS unit FROM units WHERE unit * weight <= cap),
    targets AS (SELECT *, CASE WHEN u.unit * weight > cap THEN CAST(cap AS DOUBLE) ELSE u.unit * weight END AS target FROM weighted, unit u),
    turns AS (SELECT {turns} FROM targets),
    placed AS (
        SELECT doc_id, size, source_size, rank, target, key,
               CAST(coalesce(sum(size) OVER (PARTITION BY docs.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
        FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
    asked AS (SELECT *, CASE WHEN target > 0 THEN start / target ELSE 0.0 END AS asked FROM placed),
    timed AS (SELECT *, {times} AS t FROM asked)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST({" + ".join(taken(k) for k in range(repeats))} AS BIGINT) AS taken,
           CASE WHEN size = 0 OR {taken(0)} > 0 THEN CAST(floor({position}) AS BIGINT) END AS position
    FROM timed, turns"""


def _pii() -> str:
    # The patterns without look-behind and possessive forms, which do not change what they match.
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[ -]?[0-9])+",
    }
    parts = []
    for order, kind in enumerate(pii.KINDS):
        pattern = plain.get(kind.name, kind.pattern)
        digits = "regexp_replace(value, '[^0-9]', '', 'g')"
        compact = "replace(value, ' ', '')"
        checks = {
            "ip": "list_max(list_transform(string_split(value, '.'), lambda x: CAST(x AS HUGEINT))) <= 255",
            "card": f"length({digits}) BETWEEN 14 AND 19 AND list_sum(list_transform(string_split(reverse({digits}), ''), "
            "lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) WHEN CAST(c AS INT) > 4 THEN 2 * CAST(c AS INT) - 9 ELSE 2 * CAST(c AS INT) END)) % 10 = 0",
            "phone": f"length({digits}) BETWEEN 10 AND 15",
            "iban": f"length({compact}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substring({compact}, 5) || substring({compact}, 1, 4), ''), "
            "lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INT) ELSE ascii(c) - 55 END)), lambda r, d: (r * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1",
        }
        near = f"regexp_matches(around, '(?i)(?:^|[^A-Za-z])(?:{kind.context})(?:[^A-Za-z]|$)')"
        score = f"CASE WHEN {near} THEN {kind.prior + (1 - kind.prior) * 0.7} ELSE {kind.prior} END"
        keep = "true" if kind.base else f"{score} >= {pii.KEEP}"
        parts.append(f"""
        SELECT id, '{kind.name}' AS kind, {order} AS kind_order, start, start + length(value) AS stop FROM (
            SELECT id, value, start, substring(text, greatest(start - {pii.CONTEXT}, 0) + 1, start - greatest(start - {pii.CONTEXT}, 0)) || ' '
                   || substring(text, start + length(value) + 1, {pii.CONTEXT}) AS around
            FROM (SELECT id, text, matches[k] AS value,
                         CAST(list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(matches[1:k-1], lambda m: length(m))), 0) AS BIGINT) AS start
                  FROM (SELECT id, text, matches, gaps, unnest(range(1, len(matches) + 1)) AS k
                        FROM (SELECT id, text, regexp_extract_all(text, '{pattern}') AS matches, string_split_regex(text, '{pattern}') AS gaps FROM docs))))
        WHERE {checks.get(kind.name, "true")} AND {keep}""")
    listing = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order)"
    base = [k.name for k in pii.KINDS if k.base]
    names = ", ".join(f"'{b}'" for b in base)
    counts = ", ".join(f"count(*) FILTER (kind = '{b}') AS n_{b}" for b in base)
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({" UNION ALL ".join(parts)}),
    summed AS (SELECT id, {counts}, {listing} FILTER (kind IN ({names})) AS base, {listing} AS spans FROM spans GROUP BY id)
    SELECT doc_id, {", ".join(f"coalesce(n_{b}, 0) AS n_{b}" for b in base)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM docs LEFT JOIN summed USING (id)"""


def _crc32(text: str) -> str:
    """Eight steps of the shift register for each byte, without a table."""
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: CAST('0x' || substring(hex(encode({text})), 2 * i - 1, 2) AS BIGINT))"
    fed = f"flatten(list_transform({octets}, lambda b: [b, 0, 0, 0, 0, 0, 0, 0]))"
    step = "lambda acc, b: xor(xor(acc, b) >> 1, 3988292384 * (xor(acc, b) & 1))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {fed}), {step}), 4294967295)"


def _conversation_repair() -> str:
    """Cheapest edits by dynamic programming: per row and state the least of (cost, edits) as one text."""
    r = conversation_repair

    def more(path, edit, cost):
        return f"(printf('%09d', CAST({path}[:9] AS BIGINT) + {cost}) || {path}[10:] || '{edit}')"

    def inserted(prefix):
        user = f"least({prefix}u, {more(f'{prefix}n', 'I', r.INSERT)}, {more(f'{prefix}s', 'I', r.INSERT)}, {more(f'{prefix}a', 'I', r.INSERT)})"
        return f"{prefix}n AS n, {prefix}s AS s, {user} AS u, least({prefix}a, {more(user, 'I', r.INSERT)}) AS a"

    cut = f"CASE WHEN fault = 3 THEN {r.TRUNCATED} ELSE 0 END"

    def kept(sources, initial):
        tries = [f"CASE WHEN NOT gone AND initial = '{initial}' THEN {more('p.' + x, 'K', f'{r.KEEP} + {cut}')} END" for x in sources]
        return ", ".join(tries)

    def reroled(sources):
        return ", ".join(f"CASE WHEN NOT gone THEN {more('p.' + x, 'R', f'{r.REROLE} + {cut}')} END" for x in sources)

    def deleted(x):
        return more(f"p.{x}", "D", r.DELETE)

    return f"""
    WITH RECURSIVE drawn AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % {r.DRAWS} AS draw FROM conversations),
    damaged AS (
        SELECT conv_id, turn, CASE WHEN draw = 4 THEN 'user' ELSE role END AS role,
               CASE draw WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(range(CASE WHEN draw = 3 THEN 2 ELSE 1 END)) AS copy FROM drawn WHERE draw <> 0),
    numbered AS (
        SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text[:{r.TIE_CHARS}], text) AS i FROM damaged),
    faults AS (
        SELECT *, role[:1] AS initial, CASE
            WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
            WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
            WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault,
            lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY i) || role[:1] AS pair FROM numbered),
    rows AS (SELECT *, fault IN (1, 2) AS gone FROM faults),
    names AS (SELECT DISTINCT conv_id FROM conversations),
    paths(conv_id, i, n, s, u, a) AS (
        SELECT conv_id, CAST(0 AS BIGINT), printf('%09d', 0), CAST(NULL AS VARCHAR), printf('%09d', {r.INSERT}) || 'I', printf('%09d', {2 * r.INSERT}) || 'II' FROM names
        UNION ALL
        SELECT conv_id, i, {inserted("m_")} FROM (
            SELECT p.conv_id, rows.i AS i, {deleted("n")} AS m_n, least({deleted("s")}, {kept("n", "s")}) AS m_s,
                   least({deleted("u")}, {kept("nsa", "u")}, {reroled("nsa")}) AS m_u,
                   least({deleted("a")}, {kept("u", "a")}, {reroled("u")}) AS m_a
            FROM paths p JOIN rows ON rows.conv_id IS NOT DISTINCT FROM p.conv_id AND rows.i = p.i + 1)),
    best AS (SELECT conv_id, least(n, a) AS path FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS last FROM paths) WHERE last = 1),
    edits AS (SELECT conv_id, path[9 + k] AS edit, k FROM (SELECT conv_id, path, unnest(range(1, length(path) - 8)) AS k FROM best)),
    placed AS (SELECT *, sum(CASE WHEN edit = 'I' THEN 0 ELSE 1 END) OVER o AS i, sum(CASE WHEN edit = 'D' THEN 0 ELSE 1 END) OVER o AS place
               FROM edits WINDOW o AS (PARTITION BY conv_id ORDER BY k)),
    stays AS (SELECT e.conv_id, e.k, e.edit, e.place, r.role, r.text, r.initial FROM placed e
              LEFT JOIN rows r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
    led AS (SELECT *, max(CASE WHEN place = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS led FROM stays),
    texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS body
              FROM led GROUP BY conv_id),
    counts AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank,
               count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
               count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY conv_id)
    SELECT n.conv_id, {", ".join(f"CAST(coalesce(c.{x}, 0) AS BIGINT) AS {x}" for x in ("gaps", "blank", "duplicate", "truncated", "illegal"))},
           CAST(b.path[:9] AS BIGINT) AS cost, b.path[10:] AS audit, sha256(coalesce(t.body, '')) AS repaired_sha256
    FROM names n LEFT JOIN counts c ON n.conv_id IS NOT DISTINCT FROM c.conv_id
         LEFT JOIN best b ON n.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN texts t ON n.conv_id IS NOT DISTINCT FROM t.conv_id"""


def _filter_audit() -> str:
    letters = filter_audit.LETTERS
    bits = {letter: 1 << i for i, letter in enumerate(letters)}
    tests = {**{k: v for k, v in filter_audit.FILTERS.items() if v}, "E": "coalesce(doc_id > first, false)"}
    mask = " + ".join(f"CASE WHEN {tests[k]} THEN {bit} ELSE 0 END" for k, bit in bits.items())
    before = " + ".join(f"CASE WHEN instr(filter_order, '{k}') < step THEN {bit} ELSE 0 END" for k, bit in bits.items())
    own = " ".join(f"WHEN '{k}' THEN {bit}" for k, bit in bits.items())
    fails, free = "(mask & own) > 0", "(mask & before) = 0"
    return f"""
    WITH RECURSIVE docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
    firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
    facts AS (
        SELECT part, doc_id, first, len(w) AS n_words, len(list_distinct(w)) AS n_distinct, length(text) AS n_points,
               length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper, regexp_matches(text, '[#$%&*|]') AS has_symbol,
               coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), false) AS good, coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1), false) AS toxic
        FROM docs JOIN firsts USING (text)),
    patterns AS (SELECT part, {mask} AS mask, good, toxic, count(*) AS n FROM facts GROUP BY ALL),
    orders(filter_order) AS (
        SELECT '' UNION ALL SELECT filter_order || letter FROM orders, (SELECT unnest(string_split('{letters}', '')) AS letter) WHERE instr(filter_order, letter) = 0),
    steps AS (SELECT *, {before} AS before, CASE filter_order[step] {own} END AS own
              FROM (SELECT filter_order, unnest(range(1, {len(letters) + 1})) AS step FROM orders WHERE length(filter_order) = {len(letters)})),
    counted AS (
        SELECT part, filter_order, step, own, coalesce(sum(n) FILTER ({free} AND NOT {fails}), 0) AS kept, coalesce(sum(n) FILTER ({fails} AND {free}), 0) AS removed,
               coalesce(sum(n) FILTER ({fails} AND NOT {free}), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
               coalesce(sum(n) FILTER ({fails} AND {free} AND good), 0) AS good_lost, coalesce(sum(n) FILTER ({fails} AND {free} AND toxic), 0) AS toxic_lost
        FROM patterns, steps GROUP BY ALL)
    SELECT part, filter_order, CAST(step AS INT) AS step, {", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
           CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM counted"""


ORACLE = {
    "op1_host_quality": _host_quality(),
    "op4_warc_index": _warc_index(),
    "op5_url_rules": _url_rules(),
    "op6_decontaminate": _decontaminate(),
    "op7_jaccard_links": _jaccard_links(),
    "op7_jaccard_join": _jaccard_join(),
    "op8_curriculum": _curriculum(),
    "op10_pii": _pii(),
    "op11_conversation_repair": _conversation_repair(),
    "op12_filter_audit": _filter_audit(),
}
