"""The registered queries stated in SQL, to check them with another engine.

The SQL takes the plain way (range joins, windows over whole tables) where the Spark jobs take the distributed one.
"""

from __future__ import annotations

from hindcast import fixed_values as fixed
from hindcast.plans import queries as q
from hindcast.plans import testdata as td

# Columns of the test tables, by kind (n numeric, t temporal, c categorical, g nested).
COLUMNS = {
    "benchmark": "item_id:n text:c",
    "conversations": "conv_id:n turn:n role:c text:c",
    "customer": "c_custkey:n c_name:c c_nationkey:n c_acctbal:n c_mktsegment:c",
    "documents": "doc_id:n text:c lang:c source:c n_chars:n",
    "embeddings": "vec_id:n embedding:g label:n",
    "events": "event_id:n ts:t user_id:n event_type:c value:n props:c",
    "labels": "doc_id:n quality:n toxic:n",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n "
    "l_tax:n l_returnflag:c l_linestatus:c l_shipdate:t",
    "nation": "n_nationkey:n n_name:c n_regionkey:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:c o_totalprice:n o_orderdate:t o_orderpriority:c",
    "pages": "page_id:n url:c html:c",
    "part": "p_partkey:n p_name:c p_brand:c p_type:c p_size:n p_retailprice:n",
    "region": "r_regionkey:n r_name:c",
    "supplier": "s_suppkey:n s_name:c s_nationkey:n s_acctbal:n",
}
KINDS = {"n": "numeric", "t": "temporal", "c": "categorical", "g": "generic"}


def _columns(*kinds: str, tables=td.ALL_TABLES) -> list[tuple[str, int, str, str]]:
    out = []
    for table in tables:
        for i, entry in enumerate(COLUMNS[table].split()):
            name, kind = entry.split(":")
            if not kinds or KINDS[kind] in kinds:
                out.append((table, i, name, KINDS[kind]))
    return out


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _time(expr: str) -> str:
    return f"regexp_replace(strftime({expr}, '%Y-%m-%d %H:%M:%S.%f'), '\\.000000$', '')"


def _cutoff_rows(cutoffs) -> str:
    return ", ".join(f"(TIMESTAMP '{c.isoformat(sep=' ')}')" for c in cutoffs)


def _inventory(tables=td.ALL_TABLES) -> str:
    rows = ", ".join(f"('{t}', {i}, '{c}', '{k}')" for t, i, c, k in _columns(tables=tables))
    return f"(VALUES {rows}) inv(table_name, ordinal, column_name, kind)"


def _counts(tables=td.ALL_TABLES) -> str:
    return _union(f"SELECT '{t}' AS table_name, COUNT(*) AS row_count FROM {t}" for t in tables)


# --- profile -------------------------------------------------------------------------------------------------------


def _nulls_distinct(tables=td.ALL_TABLES) -> str:
    parts = []
    for t, i, c, k in _columns(tables=tables):
        distinct = "-1" if k == "generic" else f'COUNT(DISTINCT "{c}")'
        parts.append(
            f"SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS ordinal, '{c}' AS column_name, '{k}' AS kind, "
            f'COUNT(*) AS row_count, round(SUM(CASE WHEN "{c}" IS NULL THEN 1 ELSE 0 END) / greatest(COUNT(*), 1), 6) AS null_rate, '
            f"CAST({distinct} AS BIGINT) AS distinct_count FROM {t}"
        )
    return _union(parts)


def _keys(tables=td.ALL_TABLES) -> str:
    return (
        f"SELECT table_name, any_value(row_count) AS row_count, "
        f"arg_min(column_name, ordinal) FILTER (WHERE distinct_count = row_count AND null_rate = 0) AS primary_key_guess "
        f"FROM ({_nulls_distinct(tables)}) GROUP BY table_name"
    )


def _numeric() -> str:
    return _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, CAST(MIN(\"{c}\") + 0 AS VARCHAR) AS min_value, "
        f'CAST(MAX("{c}") + 0 AS VARCHAR) AS max_value, round(AVG("{c}"), 4) AS avg_value, '
        f'round(STDDEV_SAMP("{c}"), 4) AS stddev_value FROM {t}'
        for t, _i, c, _k in _columns("numeric")
    )


def _temporal() -> str:
    return _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_time(f'MIN({c})')} AS min_value, "
        f"{_time(f'MAX({c})')} AS max_value FROM {t}"
        for t, _i, c, _k in _columns("temporal")
    )


def _tops(tables=td.ALL_TABLES) -> str:
    return _union(
        f"(SELECT '{t}' AS table_name, '{c}' AS column_name, "
        f"CAST(row_number() OVER (ORDER BY COUNT(*) DESC, CAST({c} AS VARCHAR)) AS INTEGER) AS place, "
        f"CAST({c} AS VARCHAR) AS value, COUNT(*) AS frequency FROM {t} WHERE {c} IS NOT NULL GROUP BY {c} "
        f"QUALIFY place <= {fixed.TOP_VALUES})"
        for t, _i, c, _k in _columns("categorical", tables=tables)
    )


def _relationships(star: bool, tables=td.ALL_TABLES) -> str:
    name = "regexp_replace(column_name, '^[^_]*_', '')" if star else "column_name"
    suffix = "key" if star else "\\_id"
    return f"""SELECT a.table_name AS from_table, a.column_name AS from_column, b.table_name AS to_table,
        b.column_name AS to_column, CAST({fixed.RELATIONSHIP_CONFIDENCE} AS DOUBLE) AS confidence,
        '{fixed.RELATIONSHIP_RULE}' AS evidence_rule
        FROM (SELECT *, {name} AS id_name FROM {_inventory(tables)}) a
        JOIN (SELECT *, {name} AS id_name FROM {_inventory(tables)}) b
          ON a.id_name = b.id_name AND a.table_name <> b.table_name
        WHERE a.id_name LIKE '%{suffix}' ESCAPE '\\'"""


def _support() -> str:
    columns = [(t, c) for t, _i, c, _k in _columns()]
    plain = [(t, c, c) for t, c in columns if c.endswith("_id")]
    star = [(t, c, c.split("_", 1)[1]) for t, c in columns if "_" in c and c.split("_", 1)[1].endswith("key")]
    pairs = [
        (rule, t, c, t2, c2)
        for rule, ids in (("_id", plain), ("key", star))
        for t, c, name in ids
        for t2, c2, name2 in ids
        if t != t2 and name == name2
    ]
    return _union(
        f"SELECT '{rule}' AS id_rule, '{t}' AS from_table, '{c}' AS from_column, '{t2}' AS to_table, '{c2}' AS to_column, "
        f"round(COUNT(*) FILTER (WHERE v IN (SELECT {c2} FROM {t2})) / COUNT(*), 6) AS support "
        f"FROM (SELECT DISTINCT {c} AS v FROM {t} WHERE {c} IS NOT NULL)"
        for rule, t, c, t2, c2 in pairs
    )


def _table_samples() -> str:
    parts = []
    for table, rows in [(t, fixed.PROFILE_SAMPLE_ROWS) for t in td.ALL_TABLES] + [("customer", fixed.INSPECT_SAMPLE_ROWS)]:
        columns = _columns(tables=(table,))
        forms = {"numeric": lambda c: f"{c} + 0", "temporal": _time, "categorical": lambda c: c}
        texts = ", ".join(forms[k](c) for _t, _i, c, k in columns if k in forms)
        order = ", ".join(c for _t, _i, c, _k in columns)
        parts.append(
            f"(SELECT '{table}' AS table_name, CAST({rows} AS INTEGER) AS cap, concat_ws('|', {texts}) AS row_text "
            f"FROM {table} ORDER BY {order} LIMIT {rows})"
        )
    return _union(parts)


def _summary() -> str:
    schema = f"""SELECT 'schema' AS form, {_text(fixed.SUMMARY_SCHEMA_HEADER)} || chr(10) ||
        string_agg(line, chr(10) ORDER BY table_name) AS summary FROM (
        SELECT table_name, '- ' || table_name || ': columns [' || string_agg(column_name, ', ' ORDER BY ordinal) || ']' AS line
        FROM {_inventory()} GROUP BY table_name)"""
    return f"""SELECT 'profile' AS form, {_text(fixed.SUMMARY_PROFILE_HEADER)} || chr(10) ||
        (SELECT string_agg('- ' || table_name || ': ' || row_count || ' rows, key guess ' ||
            coalesce(primary_key_guess, '{fixed.SUMMARY_NO_KEY}'), chr(10) ORDER BY table_name) FROM ({_keys()}))
        || chr(10) || '{fixed.SUMMARY_RELATIONSHIPS}' || chr(10) ||
        (SELECT string_agg('- ' || from_table || '.' || from_column || ' -> ' || to_table || '.' || to_column, chr(10)
            ORDER BY from_table, from_column, to_table)
         FROM (SELECT * FROM ({_relationships(True)}) ORDER BY from_table, from_column, to_table
               LIMIT {fixed.MAX_SUMMARY_RELATIONSHIPS})) AS summary
        UNION ALL {schema}"""


def _column_profile() -> str:
    ranges = _union(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, "
        + (
            f"CAST(MIN({c}) + 0 AS VARCHAR) AS min_value, CAST(MAX({c}) + 0 AS VARCHAR) AS max_value"
            if k == "numeric"
            else f"{_time(f'MIN({c})')} AS min_value, {_time(f'MAX({c})')} AS max_value"
        )
        + f" FROM {t}"
        for t, _i, c, k in _columns("numeric", "temporal")
    )
    return f"""SELECT p.*, coalesce(r.min_value, '') AS min_value, coalesce(r.max_value, '') AS max_value,
        coalesce(v.top_values, '') AS top_values
        FROM ({_nulls_distinct()}) p
        LEFT JOIN ({ranges}) r USING (table_name, column_name)
        LEFT JOIN (SELECT table_name, column_name, string_agg(value || '=' || frequency, '|' ORDER BY place) AS top_values
                   FROM ({_tops()}) GROUP BY ALL) v USING (table_name, column_name)"""


# --- samples -------------------------------------------------------------------------------------------------------


def _samples(task: str, entities: str, cutoffs) -> str:
    key, table = entities.split(maxsplit=1)
    return (
        f"(SELECT '{task}|' || entity_id || '|' || {_time('cutoff')} AS sample_id, entity_id, cutoff "
        f"FROM (SELECT DISTINCT CAST({key} AS VARCHAR) AS entity_id FROM {table}) "
        f"CROSS JOIN (VALUES {_cutoff_rows(cutoffs)}) c(cutoff))"
    )


def _spend_samples(cutoffs=td.SPEND_TEST) -> str:
    return _samples("customer_spend", "c_custkey customer", cutoffs)


def _priority_samples(cutoffs=td.SPEND_TEST) -> str:
    return _samples("order_priority", "c_custkey customer", cutoffs)


def _purchase_samples(cutoffs=td.PURCHASES_TEST) -> str:
    return _samples("user_purchases", "user_id events", cutoffs)


def _next_samples() -> str:
    return _samples("next_event", "user_id events", td.NEXT_EVENT_CUTOFFS)


def _spend_split(cutoffs=td.SPEND_TEST) -> str:
    return f"""(SELECT s.sample_id, s.entity_id, s.cutoff,
        CAST(coalesce(SUM(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS spend
        FROM {_spend_samples(cutoffs)} s LEFT JOIN orders o ON CAST(o_custkey AS VARCHAR) = s.entity_id
          AND o_orderdate > cutoff AND o_orderdate <= cutoff + INTERVAL {td.SPEND_DAYS} DAY
        GROUP BY ALL)"""


def _purchase_split(cutoffs=td.PURCHASES_TEST) -> str:
    return f"""(SELECT s.sample_id, s.entity_id, s.cutoff, CAST(COUNT(event_id) AS DOUBLE) AS purchases
        FROM {_purchase_samples(cutoffs)} s LEFT JOIN events e ON CAST(user_id AS VARCHAR) = s.entity_id
          AND event_type = 'purchase' AND ts > cutoff AND ts <= cutoff + INTERVAL {td.PURCHASES_DAYS} DAY
        GROUP BY ALL)"""


def _priority_split(cutoffs=td.SPEND_TEST) -> str:
    return f"""(SELECT s.sample_id, s.entity_id, s.cutoff,
        coalesce(first(o_orderpriority ORDER BY o_orderdate, o_orderkey), '') AS truth
        FROM {_priority_samples(cutoffs)} s LEFT JOIN orders o ON CAST(o_custkey AS VARCHAR) = s.entity_id
          AND o_orderdate > cutoff GROUP BY ALL)"""


def _next_split() -> str:
    return f"""(SELECT s.sample_id, s.entity_id, s.cutoff,
        coalesce(first(event_type ORDER BY ts, event_id), '') AS truth
        FROM {_next_samples()} s LEFT JOIN events e ON CAST(user_id AS VARCHAR) = s.entity_id AND ts > cutoff
        GROUP BY ALL)"""


# --- evidence ------------------------------------------------------------------------------------------------------


def _agg(samples: str, table: str, column: str) -> str:
    return f"""SELECT s.sample_id, '{table}' AS table_name, row_count,
        {_time('lo')} AS min_time, {_time('hi')} AS max_time
        FROM {samples} s JOIN (SELECT c.cutoff, COUNT({column}) AS row_count, MIN({column}) AS lo, MAX({column}) AS hi
            FROM (SELECT DISTINCT cutoff FROM {samples}) c LEFT JOIN {table} ON {column} <= c.cutoff GROUP BY c.cutoff) a
        USING (cutoff)"""


def _entity(samples: str, table: str, key: str, time: str | None, order: str) -> str:
    before = f"AND {time} <= s.cutoff" if time else ""
    return f"""SELECT s.sample_id, s.cutoff, r.*, CAST(row_number() OVER (PARTITION BY s.sample_id ORDER BY {order}) AS INTEGER) AS rn
        FROM {samples} s JOIN {table} r ON CAST(r.{key} AS VARCHAR) = s.entity_id {before}
        QUALIFY rn <= {fixed.ENTITY_ROWS}"""


ORDERS_BY = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
EVENTS_BY = "event_id, ts, user_id, event_type, value, props"


def _json(table: str) -> str:
    fields = []
    for _t, _i, c, k in _columns(tables=(table,)):
        fields.append(f"'{c}': {_time(c) if k == 'temporal' else c}")
    return "CAST(to_json({" + ", ".join(fields) + "}) AS VARCHAR)"


def _kept(rows: str) -> str:
    """Result summary of (sample_id, rn, row_json): count, number kept and the kept rows."""
    return f"""SELECT sample_id, COUNT(*) AS row_count,
        string_agg(row_json, '|' ORDER BY rn) FILTER (WHERE rn <= {fixed.KEPT_ROWS}) AS kept FROM ({rows}) GROUP BY sample_id"""


def _sql_time(column: str) -> str:
    return f"""'"{column}" <= TIMESTAMP ''' || {_time('s.cutoff')} || ''''"""


def _fact(samples, ordinal, table, fact, purpose, sql, summary) -> str:
    return f"""SELECT s.sample_id, s.entity_id, s.cutoff, CAST({ordinal} AS INTEGER) AS query_ordinal, '{table}' AS table_name,
        '{fact}' AS fact_key, '{purpose}' AS purpose, {sql} AS sql, coalesce(f.row_count, 0) AS row_count,
        coalesce(f.kept, '') AS kept FROM {samples} s LEFT JOIN ({summary}) f USING (sample_id)"""


def _agg_fact(samples, ordinal, table, column) -> str:
    json = (
        "CAST(to_json({'row_count': row_count, 'min_time': min_time, 'max_time': max_time}) AS VARCHAR)"
    )
    sql = (
        f"""'SELECT COUNT(*) AS row_count, MIN("{column}") AS min_time, MAX("{column}") AS max_time FROM "{table}" WHERE ' """
        f"|| {_sql_time(column)} || ' LIMIT {fixed.EVIDENCE_ROW_CAP}'"
    )
    summary = f"SELECT sample_id, 1 AS row_count, {json} AS kept FROM ({_agg(samples, table, column)})"
    return _fact(samples, ordinal, table, fixed.FACT_AGGREGATE, fixed.PURPOSE_AGGREGATE.format(table=table), sql, summary)


def _entity_fact(samples, ordinal, table, key, time, order) -> str:
    head = f"""'SELECT * FROM "{table}" WHERE '"""
    before = f" || {_sql_time(time)} || ' AND '" if time else ""
    entity = "CASE WHEN regexp_full_match(s.entity_id, '[0-9]+') THEN s.entity_id ELSE '''' || s.entity_id || '''' END"
    sql = f"""{head}{before} || '"{key}" = ' || {entity} || ' ORDER BY 1 LIMIT {fixed.ENTITY_ROWS}'"""
    rows = f"SELECT sample_id, rn, {_json(table)} AS row_json FROM ({_entity(samples, table, key, time, order)})"
    return _fact(samples, ordinal, table, fixed.FACT_ENTITY, fixed.PURPOSE_ENTITY.format(table=table), sql, _kept(rows))


def _sample_fact(samples, ordinal, table) -> str:
    order = ", ".join(c for _t, _i, c, _k in _columns(tables=(table,)))
    rows = f"""SELECT sample_id, rn, row_json FROM {samples} CROSS JOIN (SELECT row_number() OVER (ORDER BY {order}) AS rn,
        {_json(table)} AS row_json FROM {table} QUALIFY rn <= {fixed.ENTITY_ROWS})"""
    sql = f"""'SELECT * FROM "{table}" LIMIT {fixed.ENTITY_ROWS}'"""
    return _fact(samples, ordinal, table, fixed.FACT_SAMPLE, fixed.PURPOSE_SAMPLE.format(table=table), sql, _kept(rows))


def _priority_facts(cutoffs, s: str | None = None) -> str:
    s = s or _priority_samples(cutoffs)
    return "(" + _union(
        [
            _entity_fact(s, 0, "customer", "c_custkey", None, "c_custkey, c_name"),
            _agg_fact(s, 1, "orders", "o_orderdate"),
            _entity_fact(s, 2, "orders", "o_custkey", "o_orderdate", ORDERS_BY),
            _sample_fact(s, 3, "region"),
        ]
    ) + ")"


def _next_facts() -> str:
    s = _next_samples()
    return "(" + _union(
        [
            _agg_fact(s, 0, "events", "ts"),
            _entity_fact(s, 1, "events", "user_id", "ts", EVENTS_BY),
        ]
    ) + ")"


PRIORITY_KEYS = "customer_entity_rows|orders_aggregate_before_cutoff|orders_entity_rows|region_sample_rows"


def _reason(item: str) -> str:
    return _text(fixed.CRITIC_REASON.format(item=item))


def _matches(task, names) -> list[str]:
    """Table of each expected item, by the stated rule."""
    out = []
    for item in task.expected_evidence:
        hits = [n for n in names if any(w in n.lower() for w in item.lower().replace("_", " ").split())]
        out.append((hits or names)[0])
    return out


def _followups() -> str:
    s = _priority_samples()
    names = sorted(td.RETAIL)
    facts = {
        "customer": _entity_fact(s, 0, "customer", "c_custkey", None, "c_custkey, c_name"),
        "orders": _agg_fact(s, 1, "orders", "o_orderdate"),
    }
    parts = []
    wanted = list(zip(td.PRIORITY.expected_evidence, _matches(td.PRIORITY, names)))[: fixed.MAX_REQUESTS]
    for i, (item, table) in enumerate(wanted):
        parts.append(
            f"SELECT sample_id, CAST({i} AS INTEGER) AS position, '{item}' AS evidence_type, {_reason(item)} AS reason, "
            f"'{table}' AS table_name, row_count, kept AS sample_rows FROM ({facts[table]})"
        )
    return _union(parts)


#: By name, the first three of all retail tables: what they are ordered by, and their first time column.
FIRST_TABLES = (
    ("customer", "c_custkey, c_name", None),
    ("lineitem", ", ".join(c for _t, _i, c, _k in _columns(tables=("lineitem",))), "l_shipdate"),
    ("nation", "n_nationkey", None),
)


def _first_inspections() -> str:
    parts = []
    for table, order, time in FIRST_TABLES:
        rows = f"SELECT {_json(table)} AS row_json, row_number() OVER (ORDER BY {order}) AS rn FROM {table}"
        sql = f'SELECT * FROM "{table}" LIMIT {fixed.INSPECT_SAMPLE_ROWS}'
        parts.append(
            f"SELECT {_text(fixed.PURPOSE_INSPECT.format(table=table))} AS purpose, {_text(sql)} AS sql, COUNT(*) AS row_count, "
            f"string_agg(row_json, '|' ORDER BY rn) FILTER (WHERE rn <= {fixed.KEPT_ROWS}) AS sample_rows "
            f"FROM ({rows}) WHERE rn <= {fixed.INSPECT_SAMPLE_ROWS}"
        )
        if time:
            sql = f'SELECT MIN("{time}") AS min_value, MAX("{time}") AS max_value, COUNT(*) AS row_count FROM "{table}" '
            sql += f"LIMIT {fixed.PREDICT_ROW_CAP}"
            parts.append(
                f"SELECT {_text(fixed.PURPOSE_RANGE.format(table=table))}, {_text(sql)}, 1, CAST(to_json({{'min_value': "
                f"{_time(f'MIN({time})')}, 'max_value': {_time(f'MAX({time})')}, 'row_count': COUNT(*)}}) AS VARCHAR) FROM {table}"
            )
    return _union(f"SELECT CAST({i} AS INTEGER) AS position, * FROM ({p})" for i, p in enumerate(parts))


def _inspections() -> str:
    parts = []
    for table, order in (("customer", "c_custkey, c_name"), ("nation", "n_nationkey"), ("orders", ORDERS_BY)):
        rows = f"SELECT {_json(table)} AS row_json, row_number() OVER (ORDER BY {order}) AS rn FROM {table}"
        sql = f'SELECT * FROM "{table}" LIMIT {fixed.INSPECT_SAMPLE_ROWS}'
        parts.append(
            f"SELECT {_text(fixed.PURPOSE_INSPECT.format(table=table))} AS purpose, {_text(sql)} AS sql, COUNT(*) AS row_count, "
            f"string_agg(row_json, '|' ORDER BY rn) FILTER (WHERE rn <= {fixed.KEPT_ROWS}) AS sample_rows "
            f"FROM ({rows}) WHERE rn <= {fixed.INSPECT_SAMPLE_ROWS}"
        )
    sql = (
        'SELECT MIN("o_orderdate") AS min_value, MAX("o_orderdate") AS max_value, COUNT(*) AS row_count FROM "orders" '
        f"LIMIT {fixed.PREDICT_ROW_CAP}"
    )
    parts.append(
        f"SELECT {_text(fixed.PURPOSE_RANGE.format(table='orders'))}, {_text(sql)}, 1, CAST(to_json({{'min_value': "
        f"{_time('MIN(o_orderdate)')}, 'max_value': {_time('MAX(o_orderdate)')}, 'row_count': COUNT(*)}}) AS VARCHAR) FROM orders"
    )
    return _union(f"SELECT CAST({i} AS INTEGER) AS position, * FROM ({p})" for i, p in enumerate(parts))


def _requests(inspections: str) -> str:
    return f"""SELECT conv_id, turn,
        CASE WHEN contains(lower(text), 'likely') OR contains(lower(text), 'risk') THEN 'risk_ranking' ELSE 'forecast' END AS prediction_type,
        CASE WHEN contains(lower(text), 'customer') THEN 'customer' ELSE 'entity' END AS entity_name,
        CASE WHEN contains(lower(text), 'churn') THEN 'churn' ELSE 'future outcome' END AS target_name,
        {_text(fixed.REQUEST_SUMMARY)} AS summary, 'medium' AS confidence, {_text(fixed.REQUEST_ASSUMPTION)} AS limitations,
        position, purpose, sql, row_count, sample_rows
        FROM conversations CROSS JOIN ({inspections}) WHERE role = 'user'"""


# --- prediction ----------------------------------------------------------------------------------------------------


def _labels(cutoffs) -> str:
    """First label of the kept orders; orders come first and no other table has the column."""
    rows = _entity(_priority_samples(cutoffs), "orders", "o_custkey", "o_orderdate", ORDERS_BY)
    return f"""(SELECT s.sample_id, s.entity_id, s.cutoff, coalesce(l.label, '') AS label FROM {_priority_samples(cutoffs)} s
        LEFT JOIN (SELECT sample_id, o_orderpriority AS label FROM ({rows}) WHERE rn = 1) l USING (sample_id))"""


def _answer_fields(label: str, purposes: list[str]) -> str:
    cutoff = _time("cutoff")
    outcome = f"CASE WHEN {label} = '' THEN '{fixed.ANSWER_UNCERTAIN}' ELSE {label} END"

    def text(template: str) -> str:
        t = _text(template).replace("{entity}", "' || entity_id || '").replace("{cutoff}", f"' || {cutoff} || '")
        return t.replace("{outcome}", f"' || {outcome} || '")

    return (
        f"{text(fixed.ANSWER_SUMMARY)} AS summary, {text(fixed.ANSWER_NARRATIVE)} AS narrative_answer, "
        f"{outcome} AS prediction, 'medium' AS confidence, '{'|'.join(purposes[:3])}' AS reasoning"
    )


PRIORITY_PURPOSES = [
    fixed.PURPOSE_ENTITY.format(table="customer"),
    fixed.PURPOSE_AGGREGATE.format(table="orders"),
    fixed.PURPOSE_ENTITY.format(table="orders"),
    fixed.PURPOSE_SAMPLE.format(table="region"),
]
NEXT_PURPOSES = [fixed.PURPOSE_AGGREGATE.format(table="events"), fixed.PURPOSE_ENTITY.format(table="events")]


def _truth_match() -> str:
    answers = f"SELECT *, {_answer_fields('label', PRIORITY_PURPOSES)} FROM {_labels(td.SPEND_TEST)}"
    found = "contains(lower(summary || ' ' || narrative_answer || ' ' || reasoning || ' ' || prediction), lower(trim(truth)))"
    return f"""SELECT sample_id, truth, CASE WHEN trim(truth) <> '' AND {found} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
        (trim(truth) <> '' AND {found}) AS matched,
        CASE WHEN trim(truth) = '' THEN '{fixed.REASON_EMPTY}' WHEN {found} THEN '{fixed.REASON_MATCH}'
             ELSE '{fixed.REASON_MISS}' END AS reason
        FROM {_priority_split()} JOIN ({answers}) USING (sample_id)"""


def _spend_predictions() -> str:
    return f"""(SELECT s.*, m.train_mean, abs(m.train_mean - spend) AS absolute_error
        FROM {_spend_split()} s CROSS JOIN (SELECT AVG(spend) AS train_mean FROM {_spend_split(td.SPEND_TRAIN)}) m)"""


def _purchase_predictions() -> str:
    return f"""(SELECT s.*, m.train_mean, abs(m.train_mean - purchases) AS absolute_error
        FROM {_purchase_split()} s CROSS JOIN (SELECT AVG(purchases) AS train_mean FROM {_purchase_split(td.PURCHASES_TRAIN)}) m)"""


def _seen_orders(samples: str) -> str:
    """Latest time among the kept rows: the aggregate's, and those of the first five orders."""
    rows = _entity(samples, "orders", "o_custkey", "o_orderdate", ORDERS_BY)
    return f"""(SELECT s.sample_id, s.entity_id, s.cutoff, {_time('s.cutoff')} AS cutoff_time,
        greatest(a.max_time, a.min_time, r.latest) AS max_seen_time, coalesce(r.found, 0) AS entity_orders
        FROM {samples} s JOIN ({_agg(samples, 'orders', 'o_orderdate')}) a USING (sample_id)
        LEFT JOIN (SELECT sample_id, {_time('MAX(o_orderdate) FILTER (WHERE rn <= ' + str(fixed.KEPT_ROWS) + ')')} AS latest,
                   COUNT(*) AS found FROM ({rows}) GROUP BY sample_id) r USING (sample_id))"""


def _coerced() -> str:
    value = "CAST(value AS VARCHAR)"
    return f"""SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN value ELSE -1.0 END AS predicted_value,
        CASE WHEN event_type IN ('click', 'view') AND {value} IS NOT NULL THEN '{fixed.MODE_MODEL}'
             WHEN event_type = 'error' AND user_id % 2 = 0 THEN '{fixed.MODE_FALLBACK}'
             ELSE '{fixed.MODE_BASELINE}' END AS predictor_mode FROM events"""


# --- critic and refinement on next_event ---------------------------------------------------------------------------


def _next_states() -> str:
    """Samples of next_event with truth, label, facts and the whole first prompt."""
    rows = _entity(_next_samples(), "events", "user_id", "ts", EVENTS_BY)
    names = sorted(td.ACTIVITY)
    summary = fixed.SUMMARY_SCHEMA_HEADER + "".join(
        f"\n- {t}: columns [{', '.join(c for _t, _i, c, _k in _columns(tables=(t,)))}]" for t in names
    )
    question = _text(td.NEXT_EVENT.question_template).replace("{cutoff_time}", f"' || {_time('cutoff')} || '").replace(
        "{entity_id}", "' || entity_id || '"
    )
    cutoff = _time("cutoff")
    note = _text(fixed.PLAN_LEAKAGE_NOTE).replace("{cutoff}", f"' || {cutoff} || '")
    stated = _text(fixed.PLAN_CUTOFF_ASSUMPTION).replace("{cutoff}", f"' || {cutoff} || '")
    texts = lambda items: "[" + ", ".join(_text(i) for i in items) + "]"
    plan = f"""to_json({{'intent': '{fixed.PLAN_INTENT}', 'prediction_type': '{fixed.PLAN_TYPE}',
        'entity': {{'name': 'entity', 'entity_id': entity_id}},
        'target': {{'name': '{td.NEXT_EVENT.target_column}',
                    'description': {_text(fixed.PLAN_TARGET.format(target=td.NEXT_EVENT.target_column))},
                    'time_horizon': {_text(fixed.PLAN_HORIZON)}}},
        'needed_information': {texts(td.NEXT_EVENT.expected_evidence)},
        'candidate_tables': {texts(td.NEXT_EVENT.candidate_tables)},
        'assumptions': [{_text(fixed.PLAN_ASSUMPTION)}, {stated}, {note}], 'cutoff_time': {cutoff}}})"""
    types = {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "bigint", "event_type": "string",
             "value": "double", "props": "string"}
    columns = ", ".join(
        f"{{'column_name': '{c}', 'data_type': '{types[c]}', 'kind': '{k}'}}" for _t, _i, c, k in _columns(tables=("events",))
    )
    relevant = f"to_json([{{'table_name': 'events', 'primary_key_guess': 'event_id', 'columns': [{columns}]}}])"
    related = _relationships(False, td.ACTIVITY)
    relations = f"""(SELECT to_json(list({{'from_table': from_table, 'from_column': from_column, 'to_table': to_table,
        'to_column': to_column, 'confidence': confidence, 'evidence_rule': evidence_rule}}
        ORDER BY from_table, from_column, to_table)) FROM ({related}))"""
    summarized = """'{"row_count":' || row_count || ',"sample_rows":[' || replace(kept, '}|{', '},{') || ']}'"""
    facts = f"""(SELECT sample_id, '{{' || string_agg('"' || table_name || '_' || fact_key || '":' || {summarized}, ','
            ORDER BY query_ordinal) || '}}' AS facts,
        '[' || string_agg('{{"purpose":' || to_json(purpose) || ',"sql":' || to_json(sql) || ',"result_summary":' || {summarized} || '}}', ','
            ORDER BY query_ordinal) || ']' AS queries FROM {_next_facts()} GROUP BY sample_id)"""
    head = f"""{_text(fixed.PROMPT_HEADER)} || 'USER QUESTION:' || chr(10) || to_json({question})
        || chr(10) || chr(10) || 'DATABASE SUMMARY:' || chr(10) || to_json({_text(summary)})
        || chr(10) || chr(10) || 'TASK:' || chr(10) || {plan}
        || chr(10) || chr(10) || 'RELEVANT TABLES:' || chr(10) || {relevant}
        || chr(10) || chr(10) || 'RELATIONSHIPS:' || chr(10) || {relations}
        || chr(10) || chr(10) || 'FACTS:' || chr(10) || facts"""
    tail = "chr(10) || chr(10) || 'QUERIES RUN:' || chr(10) || queries"
    return f"""(SELECT *, head || tail AS prompt, contains(lower(head || tail), lower(truth)) AND truth <> '' AS in_prompt,
            contains(lower(answer), lower(truth)) AND truth <> '' AS in_answer
        FROM (SELECT s.*, coalesce(l.label, '') AS label, {head} AS head, {tail} AS tail,
            CASE WHEN coalesce(l.label, '') = '' THEN '{fixed.ANSWER_UNCERTAIN}' ELSE l.label END
              || ' {' '.join(NEXT_PURPOSES)} ' || 'entity_id rank prediction confidence medium reasoning supporting_facts' AS answer
        FROM {_next_split()} s JOIN {facts} f USING (sample_id)
        LEFT JOIN (SELECT sample_id, event_type AS label FROM ({rows}) WHERE rn = 1) l USING (sample_id)))"""


NEXT_SECTIONS = [
    "user_question", "database_id", "database_summary", "task", "relevant_tables", "relationships", "facts", "queries_run",
    "events_aggregate_before_cutoff", "events_entity_rows", *NEXT_PURPOSES,
]


def _sections() -> str:
    return _union(
        f"SELECT sample_id, CAST({i} AS INTEGER) AS position, '{s}' AS section FROM {_next_samples()}"
        for i, s in enumerate(NEXT_SECTIONS)
    )


def _missing(done: int = 0) -> list[str]:
    """What next_event expects and its packet does not name, after ``done`` rounds of three requests."""
    lowered = {s.lower() for s in NEXT_SECTIONS}
    left = [e for e in td.NEXT_EVENT.expected_evidence if e not in lowered]
    return left[fixed.MAX_REQUESTS * done :]


def _judgement() -> str:
    return f"""SELECT sample_id, (in_prompt OR in_answer) AS prompt_sufficient,
        CASE WHEN in_answer THEN {fixed.SCORE_TRUTH_IN_ANSWER} WHEN in_prompt THEN {fixed.SCORE_TRUTH_IN_PROMPT}
             ELSE {fixed.SCORE_TRUTH_ABSENT} END::DOUBLE AS planner_score,
        CASE WHEN in_answer THEN {1 - fixed.SCORE_TRUTH_IN_ANSWER} WHEN in_prompt THEN {1 - fixed.SCORE_TRUTH_IN_PROMPT}
             ELSE {round(1 - fixed.SCORE_TRUTH_ABSENT, 10)} END::DOUBLE AS predictor_score,
        CASE WHEN in_prompt OR in_answer THEN '' ELSE {_text(fixed.CRITIC_ASSUMPTION)} END AS wrong_assumptions,
        CASE WHEN in_prompt OR in_answer THEN {_text(fixed.CRITIC_SUFFICIENT)} ELSE {_text(fixed.CRITIC_INSUFFICIENT)} END AS comments
        FROM {_next_states()}"""


def _missing_evidence() -> str:
    missing = _missing()
    return _union(
        f"SELECT sample_id, '{'|'.join(missing)}' AS missing, CAST({i} AS INTEGER) AS position, '{m}' AS evidence_type, "
        f"{_reason(m)} AS reason, '{'high' if i == 0 else 'medium'}' AS priority FROM {_next_samples()}"
        for i, m in enumerate(missing[: fixed.MAX_REQUESTS])
    )


def _refined() -> str:
    """States with the number of rounds they go through and the prompt they end with."""
    names = sorted(td.ACTIVITY)
    first = names[0]
    matched = dict(zip(td.NEXT_EVENT.expected_evidence, _matches(td.NEXT_EVENT, names)))
    order = ", ".join(c for _t, _i, c, _k in _columns(tables=(first,)))
    first_rows = f"""(SELECT string_agg(row_json, ',' ORDER BY rn) FROM (SELECT {_json(first)} AS row_json,
        row_number() OVER (ORDER BY {order}) AS rn FROM {first} QUALIFY rn <= {fixed.KEPT_ROWS}))"""
    first_count = f"(SELECT least(COUNT(*), {fixed.ENTITY_ROWS}) FROM {first})"

    def entry(item: str) -> str:
        rows, count = ("aggregate", "1") if matched[item] == "events" else (first_rows, first_count)
        return (
            f"to_json('{item}') || ':{{\"requested_by_critic\":true,\"reason\":' || to_json({_reason(item)}) "
            f"|| ',\"rows\":[' || {rows} || '],\"row_count\":' || {count} || '}}'"
        )

    prompts = ["prompt"]
    for r in range(fixed.REFINEMENT_ROUNDS):
        items = _missing()[: (r + 1) * fixed.MAX_REQUESTS]
        if _missing(r):
            added = " || ',' || ".join(entry(i) for i in items)
            prompts.append(
                f"head || chr(10) || chr(10) || 'CRITIC-REQUESTED EVIDENCE:' || chr(10) || '{{' || {added} || '}}' || tail"
            )
    columns = ", ".join(f"{p} AS prompt{i}" for i, p in enumerate(prompts))
    found = [f"(in_answer OR (contains(lower(prompt{i}), lower(truth)) AND truth <> ''))" for i in range(len(prompts))]
    last = len(prompts) - 1
    cases = "CASE " + "".join(f"WHEN {f} THEN {i} " for i, f in enumerate(found)) + f"ELSE {last} END"
    ends = "CASE rounds " + "".join(f"WHEN {i} THEN prompt{i} " for i in range(len(prompts))) + "END"
    aggregate = f"SELECT sample_id, kept AS aggregate FROM ({_agg_fact(_next_samples(), 0, 'events', 'ts')})"
    return f"""(SELECT *, {ends} AS final_prompt FROM (SELECT *, CAST({cases} AS INTEGER) AS rounds,
        ({' OR '.join(found)}) AS sufficient FROM (SELECT *, {columns}
        FROM {_next_states()} JOIN ({aggregate}) USING (sample_id))))"""


def _score(answer: str = "answer") -> str:
    return f"CASE WHEN in_{answer} THEN 1.0 ELSE 0.0 END::DOUBLE"


def _rounds() -> str:
    names = sorted(td.ACTIVITY)
    matched = dict(zip(td.NEXT_EVENT.expected_evidence, _matches(td.NEXT_EVENT, names)))
    order = ", ".join(c for _t, _i, c, _k in _columns(tables=(names[0],)))
    first_rows = f"""(SELECT string_agg(row_json, '|' ORDER BY rn) FROM (SELECT {_json(names[0])} AS row_json,
        row_number() OVER (ORDER BY {order}) AS rn FROM {names[0]} QUALIFY rn <= {fixed.KEPT_ROWS}))"""
    first_count = f"(SELECT least(COUNT(*), {fixed.ENTITY_ROWS}) FROM {names[0]})"

    def told(item):
        rows, count = ("fact.kept", "fact.row_count") if matched[item] == "events" else (first_rows, first_count)
        return f"{_text(f'{item}#{matched[item]}#')} || {count} || '#' || {rows}"

    parts = []
    for r in range(fixed.REFINEMENT_ROUNDS):
        items = _missing(r)[: fixed.MAX_REQUESTS]
        if items:
            parts.append(
                f"SELECT sample_id, CAST({r + 1} AS INTEGER) AS round, '{'|'.join(items)}' AS evidence_types, "
                f"{_score()} AS score, in_answer AS matched, CASE WHEN truth = '' THEN '{fixed.REASON_EMPTY}' WHEN in_answer "
                f"THEN '{fixed.REASON_MATCH}' ELSE '{fixed.REASON_MISS}' END AS reason, "
                + " || '~' || ".join(told(item) for item in items)
                + f" AS evidence FROM {_refined()} JOIN (SELECT sample_id, row_count, kept FROM ({_agg_fact(_next_samples(), 0, 'events', 'ts')})) fact "
                f"USING (sample_id) WHERE rounds >= {r + 1}"
            )
    return _union(parts)


def _still_missing() -> str:
    cases = "".join(
        f"WHEN rounds = {r} THEN '{'|'.join(_missing(r))}' " for r in range(fixed.REFINEMENT_ROUNDS + 1)
    )
    return f"CASE {cases} END"


def _added() -> str:
    total = len(_missing())
    return f"least(rounds * {fixed.MAX_REQUESTS}, {total})"


def _trajectories() -> str:
    reason = f"CASE WHEN truth = '' THEN '{fixed.REASON_EMPTY}' WHEN in_answer THEN '{fixed.REASON_MATCH}' ELSE '{fixed.REASON_MISS}' END"
    return f"""SELECT sample_id, entity_id, {_time('cutoff')} AS cutoff_time, truth AS ground_truth, rounds,
        CASE WHEN sufficient THEN 'sufficient' WHEN {_still_missing()} = '' THEN 'nothing_to_request'
             WHEN rounds >= {fixed.REFINEMENT_ROUNDS} THEN 'max_rounds' ELSE 'no_new_evidence' END AS stop_reason,
        {reason} AS initial_reason, {reason} AS final_reason, sufficient AS prompt_sufficient,
        CAST({_added()} AS INTEGER) AS added, {_still_missing()} AS still_missing FROM {_refined()}"""


# --- training ------------------------------------------------------------------------------------------------------


def _uniform(prefix: str, column: str) -> str:
    return f"(('0x' || substr(md5('{prefix}:' || {column}), 1, 8))::BIGINT / 4294967296.0)"


def _role(column: str) -> str:
    shares = [q.WEIGHTS.get(r, 1.0) for r in fixed.ROLES]
    running, cases = 0.0, ""
    for role, share in zip(fixed.ROLES[:-1], shares[:-1]):
        running += share
        cases += f"WHEN {_uniform(f'{q.SEED}:role', column)} < {running / sum(shares)!r} THEN '{role}' "
    return f"CASE {cases}ELSE '{fixed.ROLES[-1]}' END"


def _episodes() -> str:
    return f"(SELECT *, {_role('sample_id')} AS target_role FROM {_refined()})"


def _sampled() -> str:
    sets = [
        ("retail", "customer_spend", _spend_samples(td.SPEND_TRAIN)),
        ("retail", "order_priority", _priority_samples()),
        ("activity", "user_purchases", _purchase_samples(td.PURCHASES_TRAIN)),
        ("activity", "next_event", _next_samples()),
    ]
    rows = _union(f"SELECT '{d}' AS dataset_name, '{t}' AS task_name, sample_id FROM {s}" for d, t, s in sets)
    u = lambda purpose: _uniform(f"{q.SEED}:{purpose}", "episode_index")
    return f"""WITH rows AS ({rows}),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY task_name ORDER BY md5(sample_id), sample_id) - 1 AS row_index FROM rows),
        sizes AS (SELECT dataset_name, task_name, COUNT(*) AS n FROM rows GROUP BY dataset_name, task_name),
        tasks AS (SELECT *, dense_rank() OVER (ORDER BY dataset_name) - 1 AS d,
            row_number() OVER (PARTITION BY dataset_name ORDER BY task_name) - 1 AS t FROM sizes),
        draws AS (SELECT range AS episode_index, CAST(floor({u('dataset').replace('episode_index', 'range')} * 2) AS BIGINT) AS d,
            CAST(floor({u('task').replace('episode_index', 'range')} * 2) AS BIGINT) AS t
            FROM range((SELECT COUNT(*) FROM orders)))
        SELECT episode_index, task_name, row_index, sample_id FROM draws JOIN tasks USING (d, t)
        JOIN numbered USING (task_name) WHERE row_index = CAST(floor({u('row')} * n) AS BIGINT)"""


def _planner_examples() -> str:
    expected = "|".join(td.NEXT_EVENT.expected_evidence)
    cutoff = _time("cutoff")
    note = _text(fixed.PLAN_LEAKAGE_NOTE).replace("{cutoff}", f"' || {cutoff} || '")
    stated = _text(fixed.PLAN_CUTOFF_ASSUMPTION).replace("{cutoff}", f"' || {cutoff} || '")
    return f"""SELECT sample_id, 3 AS turns, '{expected}' AS needed_information,
        {_text(fixed.PLAN_ASSUMPTION)} || '|' || {stated} || '|' || {note} AS assumptions, TRUE AS critic_guided,
        sufficient AS prompt_sufficient, {_score()} AS ground_truth_score FROM {_refined()}"""


def _explorer_examples() -> str:
    return f"SELECT sample_id, FALSE AS done, query_ordinal AS position, purpose, sql FROM {_next_facts()}"


def _run_state() -> str:
    counts = ", ".join(f"COUNT(*) FILTER (WHERE target_role = '{r}') AS {r}" for r in fixed.ROLES)
    return f"""SELECT COUNT(*) AS episodes, round(AVG(CAST(sufficient AS INTEGER)), 6) AS prompt_sufficiency_rate,
        round(AVG(CAST(in_answer AS INTEGER)), 6) AS ground_truth_match_rate, {counts} FROM {_episodes()}"""


def _planner_score() -> str:
    return (
        f"CASE WHEN in_answer THEN {fixed.SCORE_TRUTH_IN_ANSWER} WHEN sufficient THEN {fixed.SCORE_TRUTH_IN_PROMPT} "
        f"ELSE {fixed.SCORE_TRUTH_ABSENT} END"
    )


def _loop_metrics() -> str:
    adapters = " ".join(f"WHEN '{r}' THEN '{a}'" for r, a in fixed.ADAPTERS.items())
    missing = "CASE " + "".join(
        f"WHEN rounds = {r} THEN {len(_missing(r))} " for r in range(fixed.REFINEMENT_ROUNDS + 1)
    ) + "END"
    return f"""SELECT target_role, CASE target_role {adapters} END AS target_adapter, COUNT(*) AS episodes,
        round(AVG(CAST(in_answer AS INTEGER)), 4) AS accuracy, round(AVG(CAST(sufficient AS INTEGER)), 4) AS sufficiency_rate,
        round(AVG(rounds), 4) AS mean_rounds, round(AVG({_planner_score()}), 4) AS mean_planner_responsibility,
        round(SUM({_added()}) / SUM({missing} + {_added()}), 4) AS request_fulfilment,
        round(AVG(2 + {_added()}), 4) AS queries_per_task,
        round(AVG(len(list_filter(string_split_regex(final_prompt, '\\s+'), lambda w: w <> ''))), 4) AS mean_prompt_words,
        round(AVG(CAST(in_answer AS INTEGER)), 4) AS success_before, round(AVG(CAST(in_answer AS INTEGER)), 4) AS success_after,
        round(AVG(CAST(in_answer AND sufficient AS INTEGER)), 4) AS win_rate, 0.0::DOUBLE AS regression_rate,
        round(COUNT(*) / SUM(COUNT(*)) OVER (), 4) AS role_share FROM {_episodes()} GROUP BY target_role"""


def _example_labels() -> str:
    planner = _planner_score()
    blame = f"CASE WHEN target_role IN ('task_planner', 'sql_explorer') THEN {planner} ELSE round(1 - ({planner}), 10) END::DOUBLE"
    return f"""SELECT sample_id, target_role, {blame} AS responsibility,
        CASE WHEN sufficient AND (in_answer OR rounds > 0) THEN 'positive'
             WHEN NOT sufficient OR {blame} > 0.5 THEN 'weak' ELSE 'neutral' END AS example_label FROM {_episodes()}"""


def _pairs() -> str:
    return """WITH a AS (SELECT o_custkey, o_orderpriority, o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS s,
            CASE WHEN o_totalprice > 250000 THEN 1.0 ELSE 0.0 END AS score, o_orderkey % 3 AS rounds FROM orders),
        r AS (SELECT *, rank() OVER w AS place,
            first_value(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY s DESC, score DESC, rounds, o_orderkey DESC) AS chosen
            FROM a WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY s DESC, score DESC, rounds))
        SELECT o_custkey, o_orderpriority, chosen, o_orderkey AS rejected FROM r WHERE place > 1"""


# --- memory and logs -----------------------------------------------------------------------------------------------


def _memory_search() -> str:
    split = r"string_split_regex(lower(text), '[\t-\r\x1c-\x20\x{85}\p{Z}]+')"
    return f"""WITH words AS (SELECT item_id AS query_id, 'src' || (item_id % 20) AS scope,
            list_filter(list_distinct({split}), lambda w: w <> '') AS words FROM benchmark),
        scored AS (SELECT query_id, doc_id AS entry_id, scope, lang AS memory_type,
            CAST(len(list_filter(words, lambda w: contains(lower(lang || ' ' || text), w))) AS BIGINT) AS score
            FROM words JOIN documents ON source = scope)
        SELECT * FROM (SELECT query_id,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entry_id) AS INTEGER) AS place,
            entry_id, scope, memory_type, score FROM scored)
        WHERE place <= {fixed.MEMORY_RESULTS} AND (score > 0 OR memory_type = 'fr')"""


def _incremental() -> str:
    after = {
        "customer": "customer",
        "orders": "(SELECT * FROM orders UNION ALL SELECT * REPLACE (o_orderkey + 10000000 AS o_orderkey, "
        "o_orderdate + INTERVAL 10 DAY AS o_orderdate) FROM orders WHERE o_orderkey % 5 = 0)",
    }
    keys = {"customer": "c_custkey", "orders": "o_orderkey"}
    parts = []
    for table, _i, c, kind in _columns(tables=tuple(after)):
        number, time = kind == "numeric", kind == "temporal"
        low, high = (f"CAST({f}({c}) AS VARCHAR)" if number else _time(f"{f}({c})") if time else "NULL" for f in ("MIN", "MAX"))
        exact = f"COUNT(DISTINCT {c})" if c in q.PROFILE_KEYS[table] else "NULL"
        avg, dev = (f"round(AVG({c}), 3)", f"round(stddev_samp({c}), 3)") if number else ("NULL", "NULL")
        parts.append(
            f"SELECT '{table}' AS table_name, '{c}' AS column_name, COUNT(*) AS row_count, round(COUNT(*) FILTER ({c} IS NULL) / COUNT(*), 6) AS null_rate, "
            f"{low} AS min_value, {high} AS max_value, CAST({avg} AS DOUBLE) AS avg_value, CAST({dev} AS DOUBLE) AS stddev_value, "
            f"CAST({exact} AS BIGINT) AS exact_distinct, '{keys[table]}' AS primary_key_guess FROM {after[table]}"
        )
    return _union(parts)


FILES_READ = """SELECT refresh, table_name, action, files, 0 AS not_stored FROM (VALUES
    (1, 'customer', 'read', 2), (1, 'orders', 'read', 4), (2, 'customer', 'kept', 2), (2, 'orders', 'kept', 4),
    (2, 'orders', 'read', 1), (3, 'customer', 'kept', 2), (3, 'orders', 'kept', 5)) t(refresh, table_name, action, files)"""


def _violations() -> str:
    samples = _priority_samples(q.ALL_CUTOFFS)
    told = fixed.VIOLATION.replace("'", "''").replace("{purpose}", "' || purpose || '").replace("{value}", "' || seen || '").replace("{cutoff}", "' || cutoff_time || '")
    first = _text(fixed.PURPOSE_AGGREGATE.format(table="orders"))
    own = _text(fixed.PURPOSE_ENTITY.format(table="orders"))
    return f"""WITH seen AS (
            SELECT sample_id, 1 AS n, 1 AS place, {first} AS purpose, min_time AS seen FROM ({_agg(samples, "orders", "o_orderdate")})
            UNION ALL SELECT sample_id, 1, 2, {first}, max_time FROM ({_agg(samples, "orders", "o_orderdate")})
            UNION ALL SELECT sample_id, 2, rn, {own}, {_time('o_orderdate')} FROM ({_entity(samples, "orders", "o_custkey", "o_orderdate", ORDERS_BY)})
            WHERE rn <= {fixed.KEPT_ROWS}),
        audited AS (SELECT sample_id, {_time("CASE WHEN CAST(entity_id AS BIGINT) % 7 = 0 THEN cutoff - INTERVAL 400 DAY ELSE cutoff END")} AS cutoff_time
            FROM {samples})
        SELECT sample_id, COUNT(*) OVER (PARTITION BY sample_id) AS violations,
            CAST(row_number() OVER (PARTITION BY sample_id ORDER BY n, place) - 1 AS INTEGER) AS position, '{told}' AS violation
        FROM seen JOIN audited USING (sample_id) WHERE seen > cutoff_time"""


def _head_to_head() -> str:
    rank = "(CASE WHEN o_orderstatus = 'F' THEN 100 ELSE 0 END + CASE WHEN o_totalprice > 250000 THEN 10 ELSE 0 END - o_orderkey % 3)"
    return f"""WITH best AS (SELECT o_custkey % 100 AS input, o_orderpriority AS adapter, year(o_orderdate) AS run, MAX({rank}) AS rank
            FROM orders GROUP BY ALL),
        turns AS (SELECT *, row_number() OVER (PARTITION BY input, adapter ORDER BY run DESC) AS turn FROM best),
        met AS (
            SELECT l.adapter AS left_adapter, r.adapter AS right_adapter, l.rank AS a, r.rank AS b FROM turns l JOIN turns r USING (input)
            WHERE l.turn = 1 AND ((l.adapter < r.adapter AND r.turn = 1) OR (l.adapter = r.adapter AND r.turn = 2)))
        SELECT left_adapter, right_adapter, COUNT(*) AS inputs, COUNT(*) FILTER (a > b) AS left_wins, COUNT(*) FILTER (a < b) AS right_wins,
            COUNT(*) FILTER (a = b) AS draws, COUNT(*) FILTER (b >= 90 AND a < 90) AS sufficiency_lost,
            round(COUNT(*) FILTER (a > b) / COUNT(*), 4) AS left_win_rate,
            CASE WHEN left_adapter = right_adapter THEN round(COUNT(*) FILTER (a < b) / COUNT(*), 4) END AS regression_rate
        FROM met GROUP BY left_adapter, right_adapter"""


def _records() -> str:
    number = "CAST(entity_id AS BIGINT)"
    value = f"CASE WHEN {number} % 3 = 0 THEN CAST({number} AS DOUBLE) ELSE train_mean END"
    return f"""SELECT sample_id, 'Using only information available on or before ' || cutoff_time || ', predict spend for custkey=' || entity_id || '.' AS question,
            CASE {number} % 3 WHEN 0 THEN '{fixed.MODE_MODEL}' WHEN 1 THEN '{fixed.MODE_FALLBACK}' ELSE '{fixed.MODE_BASELINE}' END AS predictor_mode,
            round({value}, 4) AS predicted_value, round(abs({value} - spend), 4) AS absolute_error, round(spend, 2) AS ground_truth,
            'spend' AS plan_target, 'custkey' AS entity_col, round(train_mean, 4) AS train_target_mean, 3 AS queries_run, 3 AS facts,
            coalesce(max_seen_time, '') <= cutoff_time AS audit_passed, coalesce(max_seen_time, '') AS max_seen_time,
            CASE {number} % 3 WHEN 0 THEN '{{"predicted_value": ' || entity_id || '}}' WHEN 1 THEN 'no answer' ELSE '' END AS output
        FROM (SELECT sample_id, spend, train_mean FROM {_spend_predictions()}) JOIN {_seen_orders(_spend_samples())} USING (sample_id)"""


def _closure() -> str:
    gone = {
        "region": ("r_regionkey", "r_name = 'ASIA'"),
        "nation": ("n_nationkey", "n_regionkey IN (SELECT id FROM gone_region)"),
        "customer": ("c_custkey", "c_nationkey IN (SELECT id FROM gone_nation)"),
        "supplier": ("s_suppkey", "s_nationkey IN (SELECT id FROM gone_nation)"),
        "orders": ("o_orderkey", "o_custkey IN (SELECT id FROM gone_customer)"),
    }
    ctes = ", ".join(f"gone_{t} AS (SELECT {key} AS id FROM {t} WHERE {test})" for t, (key, test) in gone.items())
    tests = {
        **{t: (key, f"{key} NOT IN (SELECT id FROM gone_{t})") for t, (key, _test) in gone.items()},
        "lineitem": ("l_orderkey", "l_orderkey NOT IN (SELECT id FROM gone_orders) AND l_suppkey NOT IN (SELECT id FROM gone_supplier)"),
        "part": ("p_partkey", "true"),
    }
    return f"WITH {ctes} " + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, COUNT(*) AS rows_left, CAST(SUM({key}) AS BIGINT) AS key_sum FROM {t} WHERE {test}"
        for t, (key, test) in tests.items()
    )


def _audit() -> str:
    named = _samples("order_priority", "c_name (SELECT * FROM customer WHERE c_custkey % 50 = 0)", td.SPEND_TEST)
    both = f"(SELECT * FROM {_priority_samples(q.ALL_CUTOFFS)} UNION ALL SELECT * FROM {named})"
    column = "CASE table_name WHEN 'customer' THEN 'c_custkey' ELSE 'o_custkey' END"
    before, between, after = fixed.ERROR_ENTITY.format(entity="~", kind="bigint", column="~").split("~")
    error = f"{_text(before)} || entity_id || {_text(between)} || {column} || {_text(after)}"
    bad = f"fact_key = '{fixed.FACT_ENTITY}' AND TRY_CAST(entity_id AS BIGINT) IS NULL"
    return f"""SELECT 'analyst' AS user_id, 'retail' AS database_id, sample_id, query_ordinal, sql, purpose,
            CASE WHEN NOT ({bad}) THEN row_count END AS row_count, CASE WHEN {bad} THEN 'failed' ELSE 'success' END AS status,
            CASE WHEN {bad} THEN {error} END AS error_message FROM {_priority_facts((), both)}
        UNION ALL SELECT 'analyst', 'retail', sample_id, CAST(4 AS INTEGER), NULL, {_text(fixed.PURPOSE_ENTITY.format(table="returns"))}, NULL, 'skipped',
            {_text(fixed.ERROR_TABLE.format(table="returns"))} FROM {named}"""


def _words() -> str:
    anywhere = "[" + ", ".join(_text(w) for w in fixed.FORBIDDEN_WORDS) + "]"
    return f"""SELECT statement_id, array_to_string(list_filter({anywhere}, lambda w: contains(upper(sql), w)), '|') AS found_anywhere,
        array_to_string(list_filter({anywhere}, lambda w: list_contains(string_split_regex(upper(sql), '[^A-Z0-9_]+'), w)), '|') AS found_as_words
        FROM (SELECT sample_id || '#' || query_ordinal AS statement_id, sql FROM {_priority_facts(q.ALL_CUTOFFS)}
              UNION ALL SELECT conv_id || '#' || turn, 'select created_at from loads; drop ' || text FROM conversations)"""


def oracle() -> dict[str, str]:
    spend_seen, priority_seen = _seen_orders(_spend_samples()), _seen_orders(_priority_samples(q.ALL_CUTOFFS))
    note = _text(fixed.PLAN_LEAKAGE_NOTE).replace("{cutoff}", f"' || {_time('cutoff')} || '")
    stated = _text(fixed.PLAN_CUTOFF_ASSUMPTION).replace("{cutoff}", f"' || {_time('cutoff')} || '")
    retail = sorted(td.RETAIL)
    keys = [
        (t, k.primary_key, k.time_column, ",".join(f"{c}={r}" for c, r in sorted(k.foreign_keys.items())))
        for t, k in td.TABLE_KEYS.items()
    ]
    none = lambda v: "CAST(NULL AS VARCHAR)" if v is None else _text(v)
    return {
        "table_inventory": _union(
            f"SELECT '{t}' AS table_name, (SELECT COUNT(*) FROM {t}) AS row_count, "
            f"CAST((SELECT COUNT(*) FROM (DESCRIBE {t})) AS INTEGER) AS column_count"
            for t in td.ALL_TABLES
        ),
        "split_reader": f"""SELECT split_format, {_time('cutoff')} AS cutoff_time, COUNT(*) AS split_rows,
            CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE) AS total_spend
            FROM {_spend_split(q.ALL_CUTOFFS)} CROSS JOIN (VALUES ('jsonl'), ('json'), ('csv')) f(split_format) GROUP BY ALL""",
        "materialize_metadata": _union(
            f"SELECT '{t}' AS table_name, {none(p)} AS primary_key, {none(c)} AS time_column, {_text(f)} AS foreign_keys, "
            f"COUNT(*) AS row_count FROM {t}"
            for t, p, c, f in keys
        ),
        "fingerprint_rows": _counts(),
        "profile_row_counts": _counts(),
        "profile_nulls_distinct": f"SELECT * EXCLUDE (row_count) FROM ({_nulls_distinct()})",
        "profile_numeric": _numeric(),
        "profile_temporal": _temporal(),
        "profile_top_values": _tops(),
        "primary_key_guess": f"SELECT table_name, coalesce(primary_key_guess, '') AS primary_key_guess FROM ({_keys()})",
        "infer_relationships": f"SELECT *, '_id' AS id_rule FROM ({_relationships(False)}) UNION ALL "
        f"SELECT *, 'key' AS id_rule FROM ({_relationships(True)})",
        "relationship_support": _support(),
        "table_sample": _table_samples(),
        "fingerprint_stale": f"""SELECT table_name, row_count + CASE WHEN table_name = 'nation' THEN 1 ELSE 0 END AS row_count,
            table_name IN ('nation', 'orders') AS is_stale, table_name <> 'nation' AS same_rows
            FROM ({_counts(('customer', 'nation', 'orders', 'region'))})""",
        "database_summary": _summary(),
        "profile_refresh": f"""SELECT CASE WHEN table_name IN ({', '.join(_text(t) for t in retail)}) THEN 'retail' ELSE 'activity' END
            AS database_id, table_name, ordinal, column_name, row_count FROM ({_nulls_distinct()})""",
        "column_profile": _column_profile(),
        "date_range": _union(
            f"SELECT '{t}' AS table_name, '{c}' AS time_column, {_time(f'MIN({c})')} AS min_value, "
            f"{_time(f'MAX({c})')} AS max_value, COUNT(*) AS row_count FROM {t}"
            for t, _i, c, _k in _columns("temporal")
        ),
        "evidence_agg_cutoff": _union(
            [
                _agg(_spend_samples(q.ALL_CUTOFFS), "orders", "o_orderdate"),
                _agg(_spend_samples(q.ALL_CUTOFFS), "lineitem", "l_shipdate"),
                _agg(_purchase_samples(q.USER_CUTOFFS), "events", "ts"),
            ]
        ),
        "evidence_entity_rows": f"""SELECT sample_id, rn, o_orderkey, o_orderstatus, o_totalprice, {_time('o_orderdate')} AS o_orderdate
            FROM ({_entity(_spend_samples(q.ALL_CUTOFFS), 'orders', 'o_custkey', 'o_orderdate', ORDERS_BY)})""",
        "evidence_entity_rows_recent": f"""SELECT sample_id, rn, event_id, {_time('ts')} AS ts
            FROM ({_entity(_purchase_samples(q.USER_CUTOFFS), 'events', 'user_id', 'ts', 'ts DESC, ' + EVENTS_BY)})""",
        "evidence_entity_static": f"""SELECT sample_id, rn, c_custkey, c_name, c_mktsegment
            FROM ({_entity(_spend_samples(q.ALL_CUTOFFS), 'customer', 'c_custkey', None, 'c_custkey, c_name')})""",
        "evidence_fallback_sample": f"""SELECT sample_id, 'part' AS table_name, rn, p_partkey, p_name FROM {_spend_samples()}
            CROSS JOIN (SELECT CAST(row_number() OVER (ORDER BY p_partkey, p_name) AS INTEGER) AS rn, p_partkey, p_name FROM part
                        QUALIFY rn <= {fixed.ENTITY_ROWS})""",
        "result_summary": f"""SELECT sample_id, table_name, fact_key, row_count,
            CAST(least(row_count, {fixed.KEPT_ROWS}) AS INTEGER) AS kept_rows, kept AS sample_rows
            FROM {_priority_facts(q.ALL_CUTOFFS)}""",
        "evidence_packet": f"""SELECT sample_id, query_ordinal AS position, purpose, sql, row_count, 4 AS fact_count,
            '{PRIORITY_KEYS}' AS fact_keys FROM {_priority_facts(q.ALL_CUTOFFS)}""",
        "match_evidence_table": f"""SELECT sample_id, evidence_type, coalesce(
            list_filter([{', '.join(_text(t) for t in retail)}], lambda t: len(list_filter(
                string_split_regex(replace(lower(evidence_type), '_', ' '), '\\s+'), lambda w: contains(t, w))) > 0)[1],
            '{retail[0]}') AS table_name FROM {_priority_samples()}
            CROSS JOIN (VALUES {', '.join(f"('{e}')" for e in td.PRIORITY.expected_evidence)}) e(evidence_type)""",
        "followup_evidence": _followups(),
        "render_question": f"""SELECT sample_id, 'default' AS form, 'Using only information available on or before ' || {_time('cutoff')}
            || ', predict spend for custkey=' || entity_id || '.' AS question FROM {_spend_samples(q.ALL_CUTOFFS)}
            UNION ALL SELECT sample_id, 'template', 'Based only on rows before ' || {_time('cutoff')}
            || ', how urgent is the next order of customer ' || entity_id || '?' FROM {_priority_samples()}
            UNION ALL SELECT sample_id, 'unknown', 'Predict spend for ' || entity_id || ' using {{unknown_field}}.'
            FROM {_spend_samples(q.ALL_CUTOFFS)}
            UNION ALL SELECT sample_id, 'strict', 'Up to ' || {_time('cutoff')} || ': what does ' || entity_id || ' (retail) do?'
            FROM {_spend_samples(q.ALL_CUTOFFS)}""",
        "masked_split": f"""WITH once AS (SELECT * FROM {_spend_split(q.ALL_CUTOFFS)})
            SELECT sample_id, entity_id, {_time('cutoff')} AS cutoff_time, round(spend, 2) AS spend FROM once
            UNION ALL SELECT sample_id, entity_id, {_time('cutoff')}, round(spend + 1, 2) FROM once WHERE CAST(entity_id AS BIGINT) % 3 = 0""",
        "classify_question": """SELECT conv_id, turn,
            CASE WHEN contains(lower(text), 'likely') OR contains(lower(text), 'risk') THEN 'risk_ranking' ELSE 'forecast' END AS prediction_type,
            CASE WHEN contains(lower(text), 'customer') THEN 'customer' ELSE 'entity' END AS entity_name,
            CASE WHEN contains(lower(text), 'churn') THEN 'churn' ELSE 'future outcome' END AS target_name
            FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL
                  SELECT c_custkey, -1, 'How LIKELY is churn of customer ' || c_name || ' in ' || c_mktsegment FROM customer)""",
        "initial_plan": f"""SELECT sample_id, '{fixed.PLAN_TYPE}' AS prediction_type,
            {_text(fixed.PLAN_TARGET.format(target=td.PRIORITY.target_column))} AS target_description,
            '{'|'.join(td.PRIORITY.expected_evidence)}' AS needed_information,
            '{'|'.join(td.PRIORITY.candidate_tables)}' AS candidate_tables,
            {_text(fixed.PLAN_ASSUMPTION)} || '|' || {stated} || '|' || {note} AS assumptions, {_time('cutoff')} AS cutoff_time
            FROM {_priority_samples(q.ALL_CUTOFFS)}""",
        "predict_requests": _requests(_inspections()),
        "predict_requests_all": _requests(_first_inspections()),
        "train_mean_baseline": f"""SELECT 'customer_spend' AS task_name, round(AVG(spend), 4) AS train_mean FROM {_spend_split(td.SPEND_TRAIN)}
            UNION ALL SELECT 'user_purchases', round(AVG(purchases), 4) FROM {_purchase_split(td.PURCHASES_TRAIN)}""",
        "infer_label": f"SELECT sample_id, label FROM {_labels(q.ALL_CUTOFFS)}",
        "heuristic_answer": f"SELECT sample_id, {_answer_fields('label', PRIORITY_PURPOSES)} FROM {_labels(td.SPEND_TEST)}",
        "coerce_prediction": _coerced(),
        "regression_mae": f"""SELECT 'customer_spend' AS task_name, COUNT(*) AS rows_evaluated, round(AVG(absolute_error), 4) AS mae
            FROM {_spend_predictions()} UNION ALL SELECT 'user_purchases', COUNT(*), round(AVG(absolute_error), 4)
            FROM {_purchase_predictions()}""",
        "ground_truth_match": _truth_match(),
        "leakage_audit": f"""SELECT sample_id, cutoff_time, coalesce(max_seen_time, '') AS max_seen_time,
            CAST(0 AS BIGINT) AS violations, TRUE AS passed FROM {priority_seen}
            WHERE max_seen_time IS NULL OR max_seen_time <= cutoff_time""",
        "leakage_violations": _violations(),
        "prediction_records": _records(),
        "profile_incremental": _incremental(),
        "profile_files_read": FILES_READ,
        "evaluation_summary": f"""SELECT 'retail' AS dataset_name, 'customer_spend' AS task_name, COUNT(*) AS rows_evaluated,
            round(MAX(train_mean), 4) AS train_mean_baseline, round(AVG(absolute_error), 4) AS mae,
            CAST(COUNT(*) FILTER (WHERE max_seen_time > cutoff_time) AS BIGINT) AS leakage_failures, 'spend' AS target_col
            FROM {_spend_predictions()} JOIN (SELECT sample_id, max_seen_time, cutoff_time FROM {spend_seen}) USING (sample_id)""",
        "customer_spend": f"""SELECT sample_id, entity_id, cutoff_time, 3 AS queries, entity_orders + 1 AS entity_rows, max_seen_time,
            max_seen_time <= cutoff_time AS passed, round(train_mean, 4) AS predicted_value, round(spend, 2) AS ground_truth,
            round(absolute_error, 4) AS absolute_error FROM (SELECT sample_id, spend, train_mean, absolute_error FROM {_spend_predictions()})
            JOIN {spend_seen} USING (sample_id)""",
        "available_sections": _sections(),
        "final_prompt": f"SELECT sample_id, prompt FROM {_next_states()}",
        "critic_judgement": _judgement(),
        "missing_evidence": _missing_evidence(),
        "refine_rounds": _rounds(),
        "trajectories": _trajectories(),
        "sample_episodes": _sampled(),
        "sample_roles": f"SELECT o_orderkey, {_role('o_orderkey')} AS target_role FROM orders",
        "examples_planner": _planner_examples(),
        "examples_explorer": _explorer_examples(),
        "examples_predictor": f"""SELECT sample_id, 3 AS turns, final_prompt, {_score()} AS ground_truth_score,
            CASE WHEN label = '' THEN '{fixed.ANSWER_UNCERTAIN}' ELSE label END AS prediction FROM {_refined()}""",
        "examples_critic": f"""SELECT sample_id, final_prompt, truth AS ground_truth, sufficient AS prompt_sufficient,
            {_still_missing()} AS still_missing FROM {_refined()}""",
        "examples_written": f"""SELECT target_role, COUNT(*) AS examples, CAST(3 * COUNT(*) AS BIGINT) AS turns,
            MIN(sample_id) AS first_sample FROM {_episodes()} GROUP BY target_role""",
        "chat_text": f"""SELECT conv_id, COUNT(*) AS turns,
            string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL""",
        "run_state": _run_state(),
        "loop_metrics": _loop_metrics(),
        "example_labels": _example_labels(),
        "preference_pairs": _pairs(),
        "head_to_head": _head_to_head(),
        "memory_search": _memory_search(),
        "memory_upsert": """SELECT source AS scope, lang AS memory_type, text AS content, doc_id AS version FROM documents
            QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1""",
        "log_page": f"""SELECT event_id, {_time('ts')} AS ts, user_id, event_type FROM (
            SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50 OFFSET 100)""",
        "log_deep_page": f"""WITH placed AS (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id) - 1 AS place FROM events),
            wanted AS (SELECT *, place - (SELECT CAST(floor(COUNT(*) / 2) AS BIGINT) FROM events) AS spot FROM placed)
            SELECT CASE WHEN spot < 50 THEN 1 ELSE 2 END AS page, event_id, {_time('ts')} AS ts, user_id, event_type FROM wanted WHERE spot BETWEEN 0 AND 99""",
        "delete_closure": _closure(),
        "cascade_delete": """SELECT 'orders' AS table_name, COUNT(*) AS rows_left, CAST(SUM(o_orderkey) AS BIGINT) AS key_sum
            FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
            UNION ALL SELECT 'lineitem', COUNT(*), CAST(SUM(l_orderkey) AS BIGINT) FROM lineitem
            WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
        "query_audit": _audit(),
        "sql_word_audit": _words(),
    }
