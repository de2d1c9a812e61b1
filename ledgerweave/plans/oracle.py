"""The same results in SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from ledgerweave.functions.hashing import MODULUS, drawn

SPARSE = 10
DENSE = 8
ORDER_KEY = "o_orderdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


def _txn(block: int, extra: str = "") -> str:
    return f"""txn AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY {ORDER_KEY}) AS seq, o_orderdate AS ts, o_custkey AS sender,
             o_custkey - o_custkey % {block} + l_partkey % {block} AS receiver, l_extendedprice AS amount{extra}
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


TXN_LARGE = """txn AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS seq, o_orderdate AS ts, o_custkey AS sender,
         o_custkey - o_custkey % 400 + (o_orderkey * 31 + 7) % 400 AS receiver, o_totalprice AS amount FROM orders)"""


def _members(source: str = "txn", a: str = "sender", b: str = "receiver", prefix: str = "") -> str:
    return f"""{prefix}e AS (SELECT {a} AS u, {b} AS v FROM {source} UNION SELECT {b}, {a} FROM {source}),
    {prefix}r(a, n) AS (SELECT DISTINCT u, u FROM {prefix}e
                        UNION SELECT {prefix}r.a, {prefix}e.v FROM {prefix}r JOIN {prefix}e ON {prefix}e.u = {prefix}r.n),
    {prefix}members AS MATERIALIZED (SELECT a AS account, min(n) AS component FROM {prefix}r GROUP BY a)"""


STATS = """stats AS MATERIALIZED (
  SELECT component, count(*) AS accounts, coalesce(sum(n), 0) AS edges,
         coalesce(sum(w_out), 0.0) AS out_flow, coalesce(sum(w_in), 0.0) AS in_flow
  FROM members
  LEFT JOIN (SELECT sender, count(*) AS n, sum(greatest(1.0, amount)) AS w_out FROM txn GROUP BY 1) o ON o.sender = account
  LEFT JOIN (SELECT receiver, sum(greatest(1.0, amount)) AS w_in FROM txn GROUP BY 1) i ON i.receiver = account
  GROUP BY component),
rated AS MATERIALIZED (
  SELECT *, CASE WHEN accounts < 2 THEN 0.0 ELSE 2.0 * edges / (accounts::DOUBLE * (accounts - 1)) END AS density FROM stats)"""

LINKS = """links AS MATERIALIZED (
  SELECT x.c_custkey AS a, y.c_custkey AS b FROM customer x JOIN customer y
  ON y.c_custkey = x.c_custkey + 1 AND y.c_nationkey = x.c_nationkey)"""

OUTFLOW = """outflow AS MATERIALIZED (
  SELECT seq, sender, sum(trunc(greatest(1.0, amount))::BIGINT) OVER
    (PARTITION BY sender ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS out_hh FROM txn)"""


def _recursive(*ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body


def _z(x: str, history: str) -> str:
    """Robust z over a list column that must not be empty."""
    median = f"list_sort({history})[len({history}) // 2 + 1]"
    spread = f"list_sort(list_transform({history}, lambda q: abs(q - {median})))[len({history}) // 2 + 1]"
    return f"(CASE WHEN len({history}) > 0 THEN ({x} - {median}) / greatest(1.4826 * {spread}, 1e-9) ELSE 0.0 END)"


LEVEL = "CASE WHEN s >= 3 THEN 'HIGH' WHEN s >= 2 THEN 'MED' ELSE 'LOW' END"
REASON = """CASE WHEN z1 >= 2 AND z2 >= 2 AND z3 >= 2 THEN 'growth + concentration + density (highly suspicious)'
  WHEN z1 < 2 AND z2 < 2 AND z3 < 2 THEN 'steady'
  ELSE concat_ws(' + ', CASE WHEN z1 >= 2 THEN 'group growth' END, CASE WHEN z2 >= 2 THEN 'outflow concentration' END,
                 CASE WHEN z3 >= 2 THEN 'dense group' END) END"""

MERGES = """me AS (SELECT seq, sender AS u, receiver AS v FROM txn UNION ALL SELECT seq, receiver, sender FROM txn),
b(s, n) AS (SELECT seq, sender FROM txn UNION SELECT b.s, me.v FROM b JOIN me ON me.u = b.n AND me.seq < b.s),
merge AS MATERIALIZED (SELECT t.* FROM txn t WHERE sender <> receiver
          AND NOT EXISTS (SELECT 1 FROM b WHERE b.s = t.seq AND b.n = t.receiver))"""

_INSIDE = f"""i(s, n) AS (SELECT seq, sender FROM merge UNION SELECT i.s, me.v FROM i JOIN me ON me.u = i.n AND me.seq <= i.s),
inside AS MATERIALIZED (SELECT s, n FROM i),
sizes AS (SELECT s, count(*) AS n, min(n) AS root FROM inside GROUP BY s),
counts AS (SELECT s, count(*) AS e FROM inside JOIN txn ON txn.sender = inside.n AND txn.seq <= inside.s GROUP BY s),
{OUTFLOW},
now AS MATERIALIZED (
  SELECT sizes.s AS seq, root, sizes.n::DOUBLE AS d, e, out_hh::DOUBLE AS hh,
         2.0 * e / (sizes.n::DOUBLE * (sizes.n - 1)) AS rho
  FROM sizes JOIN counts USING (s) JOIN outflow ON outflow.seq = sizes.s),
past AS (
  SELECT s, list(d) AS hd, list(hh) AS hhh, list(rho) AS hr FROM (
    SELECT inside.s, now.*, row_number() OVER (PARTITION BY inside.s ORDER BY now.seq DESC) AS k
    FROM inside JOIN merge m ON m.sender = inside.n AND m.seq < inside.s JOIN now ON now.seq = m.seq) WHERE k <= 256 GROUP BY s)"""

_Z_VALUES = f"""zs AS (
  SELECT now.*, CASE WHEN hd IS NULL THEN 0.0 ELSE {_z('d', 'hd')} END AS z1,
         CASE WHEN hd IS NULL THEN 0.0 ELSE {_z('hh', 'hhh')} END AS z2,
         CASE WHEN hd IS NULL THEN 0.0 ELSE {_z('rho', 'hr')} END AS z3
  FROM now LEFT JOIN past ON past.s = now.seq),
scored AS MATERIALIZED (SELECT *, 0.4 * z1 + 0.4 * z2 + 0.2 * z3 AS s FROM zs)"""

SCORED = f"{MERGES},\n{_INSIDE},\n{_Z_VALUES}"


def _union_find(block: int) -> str:
    """Union-find over blocks of accounts in order of arrival: per edge the smallest account of every account's
    component, and the edges of each component under its smallest account."""
    return f"""numbered AS MATERIALIZED (
  SELECT *, sender // {block} AS block, row_number() OVER (PARTITION BY sender // {block} ORDER BY seq) AS k FROM txn),
state(block, k, seq, joins, least, label, counted) AS (
  SELECT DISTINCT block, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, range({block}), list_transform(range({block}), lambda x: 0::BIGINT) FROM numbered
  UNION ALL
  SELECT block, k, seq, a <> b, least(a, b), CASE WHEN a = b THEN label ELSE
      list_transform(label, lambda x: CASE WHEN x = greatest(a, b) THEN least(a, b) ELSE x END) END,
    list_transform(counted, lambda c, i: CASE WHEN i - 1 = least(a, b)
      THEN c + 1 + CASE WHEN a <> b THEN counted[greatest(a, b) + 1] ELSE 0 END ELSE c END)
  FROM (SELECT n.block, n.k, n.seq, label, counted, label[n.sender % {block} + 1] AS a, label[n.receiver % {block} + 1] AS b
        FROM state JOIN numbered n ON n.block = state.block AND n.k = state.k + 1))"""


def _every(txn: str, block: int, every: int) -> str:
    return _recursive(
        txn, _union_find(block), OUTFLOW,
        f"points AS (SELECT least(c * {every}, n)::BIGINT AS upto FROM (SELECT count(*) AS n FROM txn), range(1, n // {every} + 2) t(c) WHERE (c - 1) * {every} < n)",
        "newest AS (SELECT upto, block, max(seq) AS seq FROM points JOIN state ON seq <= upto GROUP BY ALL)",
        "seen AS (SELECT account, min(seq) AS first_seq FROM (SELECT sender AS account, seq FROM txn UNION ALL SELECT receiver, seq FROM txn) GROUP BY 1)",
        f"""was AS (SELECT upto, x.block * {block} + label[account % {block} + 1] AS component, count(*) AS accounts,
  any_value(counted[label[account % {block} + 1] + 1]) AS edges
  FROM newest x JOIN state s ON s.block = x.block AND s.seq = x.seq JOIN seen ON account // {block} = x.block AND first_seq <= upto GROUP BY ALL)""",
        """thick AS (SELECT *, CASE WHEN accounts < 2 THEN 0.0 ELSE 2.0 * edges / (accounts::DOUBLE * (accounts - 1)) END AS density FROM was)""",
        f"""sent AS (SELECT upto, sender, max(out_hh) AS est_out, min(seq) AS first_seq FROM points
  JOIN outflow ON seq > upto - {every // 2} AND seq <= upto GROUP BY upto, sender QUALIFY row_number() OVER (PARTITION BY upto ORDER BY est_out DESC, first_seq) <= 5)""",
        "top AS (SELECT upto, string_agg(concat(sender, '~', est_out), ', ' ORDER BY est_out DESC, first_seq) AS top_senders FROM sent GROUP BY 1)",
        body="""SELECT upto, count(*) AS num_components, upto AS num_edges, arg_min(component, (-accounts, component)) AS largest,
  max(accounts) AS largest_accounts, arg_min(component, (-density, component)) FILTER (WHERE density > 0) AS densest,
  round(max(density), 6) AS largest_density, any_value(top_senders) AS top_senders FROM thick JOIN top USING (upto) GROUP BY upto""",
    )


def _large_scored(block: int) -> str:
    return f"""{_union_find(block)},
{OUTFLOW},
joined AS MATERIALIZED (
  SELECT seq, block, least, label, sender, len(list_filter(label, lambda x: x = least)) AS n, counted[least + 1] AS e, out_hh::DOUBLE AS hh
  FROM state JOIN outflow USING (seq) WHERE joins),
now AS MATERIALIZED (
  SELECT seq, block * {block} + least AS root, n::DOUBLE AS d, e, hh, 2.0 * e / (n::DOUBLE * (n - 1)) AS rho FROM joined),
past AS (
  SELECT s, list(d) AS hd, list(hh) AS hhh, list(rho) AS hr FROM (
    SELECT x.seq AS s, now.*, row_number() OVER (PARTITION BY x.seq ORDER BY y.seq DESC) AS k
    FROM joined x JOIN joined y ON y.block = x.block AND y.seq < x.seq AND x.label[y.sender % {block} + 1] = x.least
    JOIN now ON now.seq = y.seq) WHERE k <= 256 GROUP BY s),
{_Z_VALUES}"""



def _hash(x: str, purpose: str) -> str:
    *weights, added = drawn(purpose)
    limbs = " + ".join(f"(({x} >> {16 * i}) & 65535) * {w}" for i, w in enumerate(weights))
    return f"(({added} + {limbs}) % {MODULUS})"


def _wide(x: str) -> str:
    """Ids of ten digits and more."""
    return f"({x} * 7000003 + 3000000007)"



def _kmv(members: str, k: int, account: str = "account") -> str:
    return f"""hashed AS (SELECT DISTINCT component, {_hash(account, 'kmv')} AS h FROM {members}),
kept AS (SELECT component, h FROM hashed QUALIFY row_number() OVER (PARTITION BY component ORDER BY h) <= {k}),
kmv AS (SELECT component, count(*) AS n_samples, max(h) AS top FROM kept GROUP BY component)"""


def _kmv_select(k: int) -> str:
    return f"""SELECT component, {k} AS k, n_samples, CASE WHEN n_samples >= {k} THEN top END AS r_k,
  round(1.0 / sqrt({k}), 6) AS rel_error_theory,
  round(CASE WHEN n_samples >= {k} THEN {k - 1} * ({MODULUS}.0 / top) ELSE n_samples END::DOUBLE, 3) AS estimate FROM kmv"""


def _cms(width: int, depth: int) -> str:
    def cells(account: str) -> str:
        made = ", ".join(f"{{'row': {i}, 'cell': {_hash(account, f'cell {i}')} % {width}}}" for i in range(depth))
        return f"unnest([{made}], recursive := true)"

    return f"""flows AS (SELECT sender AS account, sum(trunc(greatest(1.0, amount))::BIGINT)::BIGINT AS weight FROM txn GROUP BY 1),
spread AS (SELECT component, weight, {cells(_wide('account'))} FROM flows JOIN members USING (account)),
cells AS (SELECT component, row, cell, sum(weight)::BIGINT AS total FROM spread GROUP BY ALL),
asked AS (SELECT {_wide('account')} AS account, component, {cells(_wide('account'))} FROM members)"""


SNAPSHOTS = f"""{OUTFLOW},
cut AS (SELECT *, (seq - 1) // (SELECT (count(*) + 63) // 64 FROM txn) AS interval FROM txn),
per AS (SELECT component, interval, count(*) AS new_edges, max(seq) AS last_seq
        FROM cut JOIN members ON sender = account GROUP BY ALL),
seen AS (SELECT account, min(interval) AS interval FROM
         (SELECT sender AS account, interval FROM cut UNION ALL SELECT receiver, interval FROM cut) GROUP BY 1),
born AS (SELECT component, interval, count(*) AS new_accounts FROM seen JOIN members USING (account) GROUP BY ALL),
snap AS MATERIALIZED (
  SELECT *, CASE WHEN accounts < 2 THEN 0.0 ELSE 2.0 * edges / (accounts::DOUBLE * (accounts - 1)) END AS density FROM (
    SELECT component, interval, last_seq,
      sum(coalesce(new_accounts, 0)) OVER w::BIGINT AS accounts, sum(new_edges) OVER w::BIGINT AS edges, out_hh::DOUBLE AS out_hh
    FROM per LEFT JOIN born USING (component, interval) JOIN outflow ON outflow.seq = last_seq
    WINDOW w AS (PARTITION BY component ORDER BY interval ROWS UNBOUNDED PRECEDING)))"""


def _six(x: str) -> str:
    """Six significant digits; the factor decides ties, which the two engines round differently."""
    return f"printf('%.5e', {x} * 1.0000000000001 + 0.0)::DOUBLE"


PAIRS = """p AS MATERIALIZED (SELECT DISTINCT sender AS u, receiver AS v FROM txn WHERE sender <> receiver)"""

RECIPROCITY = """two AS (SELECT p.u, p.v, q.u IS NOT NULL AS back FROM p LEFT JOIN p q ON q.u = p.v AND q.v = p.u),
ratio AS MATERIALIZED (
  SELECT component, count(u) AS pairs, count(u) FILTER (WHERE back) AS two_way_pairs,
         CASE WHEN count(u) > 0 THEN count(u) FILTER (WHERE back) / count(u) ELSE 0.0 END AS bidirect_ratio
  FROM members LEFT JOIN two ON u = account GROUP BY component)"""

#: Hops between accounts of a component, and how many shortest ways there are.
HOPS = (
    "adj AS MATERIALIZED (SELECT u, v FROM p UNION SELECT v, u FROM p)",
    """hop(s, n, d) USING KEY (s, n) AS (SELECT account, account, 0 FROM members
  UNION SELECT DISTINCT hop.s, adj.v, hop.d + 1 FROM hop JOIN adj ON adj.u = hop.n
        LEFT JOIN recurring.hop o ON o.s = hop.s AND o.n = adj.v WHERE o.n IS NULL)""",
    "dist AS MATERIALIZED (SELECT s, n, d FROM hop)",
    """paths(s, n, d, c) AS (SELECT s, n, d, 1.0::DOUBLE FROM dist WHERE d = 0
  UNION ALL SELECT paths.s, dist.n, dist.d, sum(paths.c)::DOUBLE FROM paths JOIN adj ON adj.u = paths.n
    JOIN dist ON dist.s = paths.s AND dist.n = adj.v AND dist.d = paths.d + 1 GROUP BY ALL)""",
    "sp AS MATERIALIZED (SELECT s, n, d, c FROM paths)",
)

JUDGED = """judged AS (
  SELECT (l_returnflag = 'R')::INT AS label, (l_tax >= 0.04)::INT::DOUBLE AS prediction, l_tax AS score
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

CLASSES = f"""{JUDGED},
c AS (SELECT label::DOUBLE AS label, prediction, count(*) AS n FROM judged GROUP BY ALL),
k AS (SELECT unnest([0.0, 1.0, 2.0])::DOUBLE AS label),
f AS (SELECT k.label, coalesce((SELECT sum(n) FROM c WHERE c.label = k.label), 0)::BIGINT AS support,
        coalesce((SELECT sum(n) FROM c WHERE c.prediction = k.label), 0) AS predicted,
        coalesce((SELECT sum(n) FROM c WHERE c.prediction = k.label AND c.label = k.label), 0) AS hits FROM k),
g AS (SELECT label, support, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
        CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM f),
h AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM g)"""


def _summary(txn: str, scored: str, k: int) -> str:
    return _recursive(
        txn, _members(), STATS, scored, _kmv("members", k),
        "big AS (SELECT * FROM rated ORDER BY accounts DESC, component LIMIT 1)",
        "lm AS (SELECT * FROM scored ORDER BY seq DESC LIMIT 1)",
        """top AS (SELECT row_number() OVER (ORDER BY est_out DESC, first_seq) AS place, account, component, est_out, out_flow / 4096 AS bound FROM (
  SELECT sender AS account, min(seq) AS first_seq FROM txn WHERE seq > (SELECT max(seq) FROM txn) - 500 GROUP BY 1)
  JOIN (SELECT sender AS account, sum(trunc(greatest(1.0, amount))::BIGINT)::BIGINT AS est_out FROM txn GROUP BY 1) USING (account)
  JOIN members USING (account) JOIN stats USING (component) ORDER BY est_out DESC, first_seq LIMIT 5)""",
        body=f"""SELECT 'components' AS item, count(*)::VARCHAR AS value FROM rated
UNION ALL SELECT 'edges', sum(edges)::BIGINT::VARCHAR FROM rated
UNION ALL SELECT 'largest', component::VARCHAR FROM big UNION ALL SELECT 'largest_accounts', accounts::VARCHAR FROM big
UNION ALL SELECT 'densest', (SELECT component FROM rated WHERE density > 0 ORDER BY density DESC, component LIMIT 1)::VARCHAR
UNION ALL SELECT 'top_senders', string_agg(concat(place, ':', account, '/', component, '~', est_out, ' (+', trunc(bound)::BIGINT, ')'), ', ' ORDER BY place) FROM top
UNION ALL SELECT 'last_merge_seq', seq::VARCHAR FROM lm UNION ALL SELECT 'last_merge_root', root::VARCHAR FROM lm
UNION ALL SELECT 'last_merge_marker', CASE WHEN lm.s >= 3 THEN 'red' WHEN lm.s >= 2 THEN 'orange' ELSE 'green' END FROM lm
UNION ALL SELECT 'last_merge_reason', {REASON} FROM lm
UNION ALL SELECT 'kmv_samples', n_samples::VARCHAR FROM kmv JOIN big USING (component)
UNION ALL SELECT 'kmv_r_k', CASE WHEN n_samples >= {k} THEN top::VARCHAR ELSE 'none' END FROM kmv JOIN big USING (component)
UNION ALL SELECT 'cms_bound_out', trunc(out_flow / 4096)::BIGINT::VARCHAR FROM big""",
    )


def _refined(txn: str, least: int, window: int | None = None) -> str:
    latest = f"\n  QUALIFY row_number() OVER (PARTITION BY component ORDER BY seq DESC) <= {window}" if window else ""
    return _recursive(
        txn, _members(), STATS,
        f"""win AS MATERIALIZED (SELECT component, seq, sender, receiver, amount FROM txn JOIN members ON account = sender
  WHERE component IN (SELECT component FROM rated WHERE edges >= {least}){latest})""",
        """mutual AS MATERIALIZED (SELECT DISTINCT x.component, x.sender AS a, x.receiver AS b FROM win x JOIN win y
  ON x.component = y.component AND y.sender = x.receiver AND y.receiver = x.sender WHERE x.sender <> x.receiver)""",
        _members("mutual", "a", "b", "q"),
        """blk AS MATERIALIZED (SELECT DISTINCT m.component, q.account, q.component AS block FROM qmembers q JOIN mutual m ON m.a = q.account)""",
        """size AS (SELECT component, block, count(*) AS accounts FROM blk GROUP BY ALL)""",
        """flow AS (SELECT s.block, count(*) AS edges, sum(greatest(1.0, amount)) AS out_flow FROM win
  JOIN blk s ON s.account = sender JOIN blk d ON d.account = receiver AND d.block = s.block GROUP BY 1)""",
        body=f"""SELECT component, block, true AS refined, accounts, edges, round(out_flow, 2) AS out_flow,
  round(2.0 * edges / (accounts::DOUBLE * (accounts - 1)), 6) AS density FROM size JOIN flow USING (block)
UNION ALL SELECT component, component, false, accounts, edges::BIGINT, round(out_flow, 2), round(density, 6) FROM rated
WHERE edges >= {least} AND component NOT IN (SELECT component FROM blk)""",
    )


LEARNING = f"""{_txn(DENSE, ", (l_returnflag = 'R')::INT AS flag, o_orderpriority, l_suppkey")},
learning AS MATERIALIZED (
  SELECT seq, seq <= (SELECT floor(count(*) * 0.8) FROM txn) AS early, amount, flag, o_orderpriority AS Payment_type,
         pn.n_name AS Sender_bank_location, pr.r_name AS Payment_currency, qn.n_name AS Receiver_bank_location, qr.r_name AS Received_currency
  FROM txn JOIN customer ON c_custkey = sender JOIN nation pn ON pn.n_nationkey = c_nationkey JOIN region pr ON pr.r_regionkey = pn.n_regionkey
  JOIN supplier ON s_suppkey = l_suppkey JOIN nation qn ON qn.n_nationkey = s_nationkey JOIN region qr ON qr.r_regionkey = qn.n_regionkey)"""

CATEGORIES = ["Payment_currency", "Received_currency", "Sender_bank_location", "Receiver_bank_location", "Payment_type"]

#: One-hot places after the amount: categories in turn, their values by frequency among the earlier rows, then by name.
ENCODED = f"""{LEARNING},
cells AS MATERIALIZED ({" UNION ALL ".join(f"SELECT seq, early, {i} AS turn, '{c}' AS category, {c} AS value FROM learning" for i, c in enumerate(CATEGORIES))}),
named AS MATERIALIZED (
  SELECT category, value, row_number() OVER (ORDER BY turn, n DESC, value) AS slot
  FROM (SELECT turn, category, value, count(*) AS n FROM cells WHERE early GROUP BY ALL))"""


def oracle_sql() -> dict[str, str]:
    sparse, dense = _txn(SPARSE), _txn(DENSE)
    components = (sparse, _members())
    entities = f"""x AS MATERIALIZED (SELECT DISTINCT unnest([sender, receiver]) AS account FROM txn),
    {LINKS}, {_members('links', 'a', 'b', 'k')},
    entity AS MATERIALIZED (SELECT x.account, coalesce(km.component, x.account) AS component
                            FROM x LEFT JOIN kmembers km ON km.account = x.account)"""
    between = """cg AS MATERIALIZED (SELECT s.component AS cu, d.component AS cv, amount AS w FROM txn
      JOIN entity s ON s.account = sender JOIN entity d ON d.account = receiver WHERE s.component <> d.component)"""
    large = TXN_LARGE
    events = """txn AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ts, user_id, k, value) AS seq, ts, user_id AS sender, k AS receiver, value AS amount
      FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))"""
    judged_merges = f"""SELECT seq, root, d AS distinct, e AS edges, hh AS out_hh, round(rho, 6) AS density,
  {_six('scored.s')} AS s, {LEVEL.replace('s >=', 'scored.s >=')} AS level, {REASON} AS reason FROM scored"""
    alerts = f"""SELECT epoch(ts)::DOUBLE AS time, root::VARCHAR AS root, sender::VARCHAR AS src, receiver::VARCHAR AS dst, amount,
  {_six('round(s, 4)')} AS S, {LEVEL} AS level, d AS distinct, hh AS out_hh, round(rho, 6) AS density, {_six('round(z1, 3)')} AS z_distinct,
  {_six('round(z2, 3)')} AS z_out_hh, {_six('round(z3, 3)')} AS z_density FROM scored JOIN txn USING (seq)"""
    return {
        "txn_normalised": """
WITH raw AS (
  SELECT CASE WHEN l_orderkey % 50 <> 0 THEN epoch(o_orderdate)::DOUBLE END AS t, o_custkey AS sender,
         o_custkey - o_custkey % 10 + l_partkey % 10 AS receiver,
         CASE WHEN l_linenumber % 7 = 0 THEN 0.0 ELSE l_extendedprice END AS amount
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT row_number() OVER (ORDER BY t NULLS LAST, sender, receiver, amount) AS seq, * FROM raw)
SELECT seq, coalesce(t, seq - 1)::DOUBLE AS tnum, sender, receiver, amount, greatest(1.0, amount) AS weight FROM n""",
        "time_normalise": """
WITH o AS (SELECT o_orderkey, epoch(o_orderdate)::BIGINT + o_orderkey % 86400 + o_orderkey // 7 % 2 * 378691200 AS sec, o_orderkey % 12 AS kind FROM orders),
t AS (SELECT *, make_timestamp(sec * 1000000) AS m FROM o),
w AS (SELECT *, CASE kind
    WHEN 0 THEN strftime(m, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(m, '%Y/%m/%d %H:%M:%S')
    WHEN 2 THEN strftime(m, '%Y-%m-%d %H:%M') WHEN 3 THEN strftime(m, '%Y/%m/%d %H:%M')
    WHEN 4 THEN strftime(m, '%Y-%m-%d') WHEN 5 THEN strftime(m, '%Y/%m/%d')
    WHEN 6 THEN strftime(m, '%m/%d/%Y %H:%M:%S') WHEN 7 THEN strftime(m, '%m/%d/%Y %H:%M')
    WHEN 8 THEN strftime(m, '%m/%d/%Y') WHEN 9 THEN sec::VARCHAR WHEN 10 THEN (sec * 1000)::VARCHAR ELSE 'bad' END AS text FROM t),
d AS (SELECT *, try_cast(regexp_replace(text, '[^0-9]', '', 'g') AS DOUBLE) AS digits FROM w)
SELECT o_orderkey, text,
  CASE WHEN kind IN (0, 1, 6, 9) THEN sec WHEN kind = 10 THEN CASE WHEN sec * 1000 > 1e12 THEN sec ELSE sec * 1000 END WHEN kind IN (2, 3, 7) THEN sec - sec % 60
       WHEN kind IN (4, 5, 8) THEN sec - sec % 86400 END::DOUBLE AS seconds,
  coalesce(try_cast(text AS DOUBLE), CASE WHEN digits > 1e12 THEN digits / 1000 WHEN digits > 0 THEN digits END) AS legacy_seconds,
  sec AS joined_seconds FROM d""",
        "wcc": _recursive(*components, body="SELECT account, component FROM members"),
        "component_stats": _recursive(
            *components, STATS,
            body="SELECT component, accounts, edges::BIGINT AS edges, round(out_flow, 2) AS out_flow, round(in_flow, 2) AS in_flow, round(density, 6) AS density FROM rated",
        ),
        "component_extremes": _recursive(
            *components, STATS,
            body="""SELECT count(*) AS num_components, sum(edges)::BIGINT AS num_edges,
  (SELECT component FROM rated ORDER BY accounts DESC, component LIMIT 1) AS largest, max(accounts) AS largest_accounts,
  (SELECT component FROM rated WHERE density > 0 ORDER BY density DESC, component LIMIT 1) AS densest,
  round(max(density), 6) AS largest_density FROM rated""",
        ),
        "entity_contract": _recursive(
            LINKS, _members("links", "a", "b"),
            body="SELECT c_custkey AS account, coalesce(component, c_custkey) AS component FROM customer LEFT JOIN members ON account = c_custkey",
        ),
        "component_graph": _recursive(dense, entities, between, body="SELECT cu, cv, w FROM cg"),
        "risk_distance": _recursive(
            dense, entities, between,
            "g AS MATERIALIZED (SELECT cu AS u, cv AS v, min(w) AS w FROM cg GROUP BY 1, 2)",
            """d(s, n, dist) USING KEY (s, n) AS (
    SELECT DISTINCT component, component, 0.0::DOUBLE FROM txn JOIN entity ON account = sender WHERE sender % 8 = 0
    UNION SELECT d.s, g.v, min(d.dist + g.w) FROM d JOIN g ON g.u = d.n
          LEFT JOIN recurring.d o ON o.s = d.s AND o.n = g.v
          WHERE o.n IS NULL OR d.dist + g.w < o.dist GROUP BY 1, 2)""",
            body="SELECT s AS source, n AS component, round(dist, 2) AS distance FROM d",
        ),
        "nearest_risk": _recursive(
            dense, entities, between,
            "g AS MATERIALIZED (SELECT cu AS u, cv AS v, min(w) AS w FROM cg GROUP BY 1, 2)",
            """d(s, n, dist) USING KEY (s, n) AS (
    SELECT DISTINCT component, component, 0.0::DOUBLE FROM txn JOIN entity ON account = sender WHERE sender % 64 = 0
    UNION SELECT d.s, g.v, min(d.dist + g.w) FROM d JOIN g ON g.u = d.n
          LEFT JOIN recurring.d o ON o.s = d.s AND o.n = g.v
          WHERE o.n IS NULL OR d.dist + g.w < o.dist GROUP BY 1, 2)""",
            body="""SELECT arg_min(s, (dist, s)) AS source, n AS component, round(min(dist), 2) AS distance FROM d WHERE dist <= 60000 GROUP BY n""",
        ),
        "path_distance": """
WITH places AS (SELECT c_custkey AS node, coalesce(sum(1 + c_custkey % 7) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM customer
  UNION ALL SELECT max(c_custkey) + 1, sum(1 + c_custkey % 7) FROM customer)
SELECT s.node AS source, x.node, (x.far - s.far)::DOUBLE AS dist FROM places x JOIN places s ON s.node = x.node // 1000 * 1000
WHERE s.node <= (SELECT max(c_custkey) FROM customer)""",
        "account_flow": f"""
WITH {sparse}
SELECT account, sum(sent)::BIGINT AS sent, sum(ow)::BIGINT AS out_whole, sum(iw)::BIGINT AS in_whole,
       round(sum(o), 2) AS out_flow, round(sum(i), 2) AS in_flow FROM (
  SELECT sender AS account, 1 AS sent, trunc(greatest(1.0, amount))::BIGINT AS ow, 0 AS iw, greatest(1.0, amount) AS o, 0.0::DOUBLE AS i FROM txn
  UNION ALL SELECT receiver, 0, 0, trunc(greatest(1.0, amount))::BIGINT, 0.0::DOUBLE, greatest(1.0, amount) FROM txn) GROUP BY account""",
        "running_outflow": f"WITH {sparse}, {OUTFLOW} SELECT seq, sender, out_hh FROM outflow",
        "top_senders": _recursive(
            *components, STATS,
            body="""SELECT row_number() OVER (ORDER BY est_out DESC, first_seq)::INT AS place, account, component, est_out, round(out_flow / 4096, 4) AS bound FROM (
  SELECT sender AS account, min(seq) AS first_seq FROM txn WHERE seq > (SELECT max(seq) FROM txn) - 500 GROUP BY 1)
JOIN (SELECT sender AS account, sum(trunc(greatest(1.0, amount))::BIGINT)::BIGINT AS est_out FROM txn GROUP BY 1) USING (account)
JOIN members USING (account) JOIN stats USING (component) ORDER BY est_out DESC, first_seq LIMIT 5""",
        ),
        "kmv_distinct": _recursive(*components, _kmv("members", 4), body=_kmv_select(4)),
        "large_kmv_distinct": _recursive(large, _members(), _kmv("members", 128), body=_kmv_select(128)),
        "kmv_by_region": f"""
WITH m AS (SELECT c_custkey AS account, n_regionkey AS component FROM customer JOIN nation ON c_nationkey = n_nationkey),
{_kmv('m', 128, _wide('account'))} {_kmv_select(128)}""",
        "theta_distinct": _recursive(
            *components, body="SELECT component, count(*)::DOUBLE AS estimate FROM members GROUP BY component"
        ),
        "cms_flow": _recursive(
            *components, _cms(16, 3),
            body="""SELECT account, component, min(coalesce(total, 0))::BIGINT AS estimate
FROM asked LEFT JOIN cells USING (component, row, cell) GROUP BY ALL""",
        ),
        "cms_report": _recursive(
            *components, STATS,
            body="""SELECT component, 4096 AS w, 6 AS d, round(1.0 / 4096, 6) AS epsilon, round(exp(1) / 4096, 6) AS epsilon_published,
  round(exp(-6), 6) AS delta, round(out_flow, 2) AS n_out, round(in_flow, 2) AS n_in, round(out_flow / 4096, 2) AS bound_out,
  round(in_flow / 4096, 2) AS bound_in, round(exp(1) / 4096 * out_flow, 2) AS bound_out_published FROM stats""",
        ),
        "sketch_merge": _recursive(
            *components, _cms(16, 3), _kmv("members", 4, _wide("account")),
            f"est AS ({_kmv_select(4)})",
            body="""SELECT est.component, est.estimate, c.cells, c.fullest FROM est LEFT JOIN
  (SELECT component, count(*) AS cells, max(total) AS fullest FROM cells GROUP BY 1) c ON c.component = est.component""",
        ),
        "reciprocal_pairs": f"WITH {dense}, {PAIRS} SELECT p.u AS src, p.v AS dst FROM p JOIN p q ON q.u = p.v AND q.v = p.u",
        "reciprocity": _recursive(
            *components, PAIRS, RECIPROCITY,
            body="SELECT component, pairs, two_way_pairs, round(bidirect_ratio, 6) AS bidirect_ratio FROM ratio",
        ),
        "latest_edges": _recursive(
            dense, _members(),
            body="""SELECT component, seq FROM txn JOIN members ON sender = account
WHERE seq > (SELECT count(*) - count(*) // 2 FROM txn)
QUALIFY row_number() OVER (PARTITION BY component ORDER BY seq DESC) <= 8""",
        ),
        "refine_blocks": _refined(dense, 20),
        "large_refine_blocks": _refined(large, 0, 2000),
        "merge_events": _recursive(sparse, MERGES, body="SELECT seq, sender, receiver FROM merge"),
        "merge_scores": _recursive(sparse, SCORED, body=judged_merges),
        "large_merge_scores": _recursive(large, _large_scored(400), body=judged_merges),
        "alert_csv": _recursive(sparse, SCORED, body=alerts),
        "large_alert_csv": _recursive(large, _large_scored(400), body=alerts),
        "interval_scores": _recursive(
            *components, SNAPSHOTS,
            f"""hist AS (SELECT *, list(accounts::DOUBLE) OVER w AS hd, list(out_hh) OVER w AS hhh, list(density) OVER w AS hr FROM snap
  WINDOW w AS (PARTITION BY component ORDER BY interval ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))""",
            f"""sc AS (SELECT *, CASE WHEN hd IS NULL THEN 0.0 ELSE 0.4 * {_z('accounts', 'hd')} + 0.4 * {_z('out_hh', 'hhh')} + 0.2 * {_z('density', 'hr')} END AS s FROM hist)""",
            body=f"SELECT component, interval, last_seq, accounts, edges, out_hh, round(density, 6) AS density, {_six('sc.s')} AS s, {LEVEL.replace('s >=', 'sc.s >=')} AS level FROM sc",
        ),
        "latest_interval": _recursive(
            *components, SNAPSHOTS,
            body="""SELECT component, interval, last_seq, accounts, edges, out_hh, round(density, 6) AS density FROM snap
QUALIFY row_number() OVER (PARTITION BY component ORDER BY interval DESC) = 1""",
        ),
        "robust_z": _recursive(
            dense, _members(),
            """h AS (SELECT seq, component, amount, list(amount) OVER (PARTITION BY component ORDER BY seq
  ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING) AS past FROM txn JOIN members ON sender = account)""",
            f"zz AS (SELECT seq, component, CASE WHEN past IS NULL THEN 0.0 ELSE {_z('amount', 'past')} END AS raw FROM h)",
            body=f"SELECT seq, component, {_six('raw')} AS z FROM zz",
        ),
        "summary_report": _summary(sparse, SCORED.replace("sizes", "msizes"), 8),
        "large_summary_report": _summary(large, _large_scored(400), 128),
        "summary_every": _every(sparse, 10, 1000),
        "large_summary_every": _every(large, 400, 250),
        "graph_features": _recursive(
            *components, PAIRS, RECIPROCITY, STATS,
            "deg AS (SELECT a, count(*) AS degree FROM (SELECT u AS a FROM p UNION ALL SELECT v FROM p) GROUP BY 1)",
            "adj AS MATERIALIZED (SELECT u, v FROM p UNION SELECT v, u FROM p)",
            """hop(s, n, d) AS (SELECT account, account, 0 FROM members
  UNION SELECT hop.s, adj.v, hop.d + 1 FROM hop JOIN adj ON adj.u = hop.n WHERE hop.d < 10)""",
            "dist AS MATERIALIZED (SELECT s, n, min(d) AS d FROM hop GROUP BY ALL)",
            """paths(s, n, d, c) AS (SELECT s, n, d, 1.0::DOUBLE FROM dist WHERE d = 0
  UNION ALL SELECT paths.s, dist.n, dist.d, sum(paths.c)::DOUBLE FROM paths JOIN adj ON adj.u = paths.n
    JOIN dist ON dist.s = paths.s AND dist.n = adj.v AND dist.d = paths.d + 1 GROUP BY ALL)""",
            "sp AS MATERIALIZED (SELECT s, n, d, sum(c) AS c FROM paths GROUP BY ALL)",
            """btw AS (SELECT x.n AS a, sum(x.c * y.c / z.c) / 2 AS b FROM sp x JOIN sp y ON y.s = x.n
  JOIN sp z ON z.s = x.s AND z.n = y.n AND z.d = x.d + y.d WHERE x.s <> x.n AND y.n <> x.n GROUP BY 1)""",
            "clo AS (SELECT s AS a, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) ELSE 0.0 END AS c FROM dist GROUP BY 1)",
            """feat AS (SELECT account, component, coalesce(degree, 0)::BIGINT AS degree, coalesce(c, 0.0) AS closeness, coalesce(b, 0.0) AS betweenness
  FROM members LEFT JOIN deg ON deg.a = account LEFT JOIN clo ON clo.a = account LEFT JOIN btw ON btw.a = account)""",
            body="""SELECT seq, s.component, st.accounts AS group_node_count, st.edges::BIGINT AS group_edge_count,
  s.degree AS sender_degree, r.degree AS receiver_degree, round(s.closeness, 4) AS sender_closeness, round(s.betweenness, 4) AS sender_betweenness,
  round(ratio.bidirect_ratio, 4) AS group_bidirect_ratio, round(r.closeness, 4) AS receiver_closeness, round(r.betweenness, 4) AS receiver_betweenness
FROM txn JOIN feat s ON s.account = sender JOIN feat r ON r.account = receiver
JOIN stats st ON st.component = s.component JOIN ratio ON ratio.component = s.component""",
        ),
        "mixed_features": _recursive(
            """txn AS MATERIALIZED (
  SELECT o_custkey AS sender, o_custkey - o_custkey % 400 + (o_orderkey * 31 + 7) % 400 AS receiver FROM orders
  UNION ALL SELECT o_custkey + 10000000, o_custkey - o_custkey % 10 + l_partkey % 10 + 10000000 FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
            _members(), PAIRS, *HOPS,
            "deg AS (SELECT a, count(*) AS degree FROM (SELECT u AS a FROM p UNION ALL SELECT v FROM p) GROUP BY 1)",
            """btw AS (SELECT x.n AS a, sum(x.c * y.c / z.c) / 2 AS b FROM sp x JOIN sp y ON y.s = x.n
  JOIN sp z ON z.s = x.s AND z.n = y.n AND z.d = x.d + y.d WHERE x.s <> x.n AND y.n <> x.n GROUP BY 1)""",
            "clo AS (SELECT s AS a, CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) ELSE 0.0 END AS c FROM dist GROUP BY 1)",
            body="""SELECT account, component, coalesce(degree, 0)::BIGINT AS degree, round(coalesce(c, 0.0), 6) AS closeness,
  round(coalesce(b, 0.0), 3) AS betweenness, count(*) OVER (PARTITION BY component) > 100 AS estimated
FROM members LEFT JOIN deg ON deg.a = account LEFT JOIN clo ON clo.a = account LEFT JOIN btw ON btw.a = account""",
        ),
        "pivot_betweenness": _recursive(
            large, _members(), PAIRS, *HOPS,
            f"""piv AS MATERIALIZED (SELECT account, component FROM members
  QUALIFY row_number() OVER (PARTITION BY component ORDER BY {_hash(_hash('account', 'pivot'), 'pivot again')}) <= 24)""",
            "size AS (SELECT component, count(*)::DOUBLE AS n, least(count(*), 24)::DOUBLE AS k FROM members GROUP BY 1)",
            """single AS (SELECT u AS a, min(v) AS holder FROM adj GROUP BY 1 HAVING count(*) = 1)""",
            """leaf AS MATERIALIZED (SELECT x.a, x.holder FROM single x LEFT JOIN single y ON y.a = x.holder WHERE y.a IS NULL OR x.a > y.a)""",
            "tree AS MATERIALIZED (SELECT account, count(leaf.a)::DOUBLE AS h FROM members LEFT JOIN leaf ON holder = account GROUP BY 1)",
            # Of a pivot elsewhere: what goes through, less the ways that end in a leaf at the account.
            """carried AS (SELECT x.s, x.n AS a, sum(x.c * y.c / z.c) - any_value(h) AS share FROM sp x JOIN sp y ON y.s = x.n
  JOIN sp z ON z.s = x.s AND z.n = y.n AND z.d = x.d + y.d JOIN tree ON tree.account = x.n
  WHERE x.s IN (SELECT account FROM piv) AND x.s <> x.n AND y.n <> x.n
    AND NOT EXISTS (SELECT 1 FROM leaf WHERE leaf.a = x.s AND leaf.holder = x.n) GROUP BY 1, 2)""",
            "summed AS (SELECT a, sum(share) AS t, sum(share * share) AS q FROM carried WHERE a NOT IN (SELECT a FROM leaf) GROUP BY 1)",
            body="""SELECT account, k::BIGINT AS pivots, round(h * (h - 1) / 2 + h * (n - 1 - h) + n / k * coalesce(t, 0.0) / 2, 3) AS betweenness,
  round(CASE WHEN k >= n THEN 0.0 WHEN k > 1 THEN
    n / 2 * sqrt((1 - k / n) * greatest(0.0, coalesce(q, 0.0) - coalesce(t, 0.0) * coalesce(t, 0.0) / k) / (k - 1) / k) END, 2) AS error
FROM members JOIN size USING (component) JOIN tree USING (account) LEFT JOIN summed ON a = account""",
        ),
        "sketched_closeness": _recursive(
            large, _members(), PAIRS, *HOPS[:2],
            body="""SELECT s AS account, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1) / sum(d) ELSE 0.0 END, 6) AS closeness, true AS within
FROM hop GROUP BY s""",
        ),
        "temporal_split": f"WITH {dense} SELECT seq, CASE WHEN seq <= (SELECT floor(count(*) * 0.8) FROM txn) THEN 'train' ELSE 'test' END AS side FROM txn",
        "split_except": f"""WITH {dense},
n AS (SELECT epoch(ts)::BIGINT AS timestamp, sender, receiver, row_number() OVER (ORDER BY ts, sender, receiver) AS place FROM txn)
SELECT timestamp, sender, receiver FROM n EXCEPT
SELECT timestamp, sender, receiver FROM n WHERE place <= (SELECT floor(count(*) * 0.8) FROM n)""",
        "category_index": """
SELECT value, count, row_number() OVER (ORDER BY count DESC, value) - 1 AS index FROM (
  SELECT o_orderpriority AS value, count(*) AS count FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  GROUP BY 1)""",
        "confusion": f"WITH {JUDGED} SELECT label::DOUBLE AS label, prediction, count(*) AS n FROM judged GROUP BY ALL",
        "class_metrics": f"""WITH {CLASSES},
w AS (SELECT sum(precision * support) / sum(support) AS p, sum(recall * support) / sum(support) AS r, sum(f1 * support) / sum(support) AS f FROM h)
SELECT label, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  round(p, 6) AS weighted_precision, round(r, 6) AS weighted_recall, round(f, 6) AS weighted_f1 FROM h, w""",
        "class_support": f"""WITH {JUDGED}, k AS (SELECT unnest([0.0, 1.0, 2.0])::DOUBLE AS label)
SELECT k.label, count(judged.label) AS support FROM k LEFT JOIN judged ON judged.label = k.label GROUP BY k.label""",
        "auc": f"""WITH {JUDGED},
ranked AS (SELECT label, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2) AS mean_rank FROM judged),
t AS (SELECT sum(mean_rank) FILTER (WHERE label = 1) AS r, count(*) FILTER (WHERE label = 1)::DOUBLE AS p, count(*) FILTER (WHERE label = 0)::DOUBLE AS n FROM ranked)
SELECT round((r - p * (p + 1) / 2) / (p * n), 6) AS auc FROM t""",
        "encoded_features": f"""WITH {ENCODED}
SELECT seq, slot::INT AS slot, 1.0::DOUBLE AS value FROM cells JOIN named USING (category, value) WHERE NOT early
UNION ALL SELECT seq, 0, amount FROM learning WHERE NOT early AND amount <> 0""",
        "feature_slots": f"""WITH {ENCODED}
SELECT slot::INT AS slot, concat(category, '_vec_', value) AS feature FROM named UNION ALL SELECT 0, 'Amount'""",
        "ablation_support": f"""WITH {LEARNING}
SELECT feature_set, model, label, support FROM
  (SELECT flag AS label, count(*) AS support FROM learning WHERE NOT early GROUP BY 1),
  (SELECT unnest(['raw_and_graph', 'raw', 'graph']) AS feature_set),
  (SELECT unnest(['logistic_regression', 'decision_tree', 'random_forest', 'linear_svm']) AS model)""",
        "stream_components": _recursive(
            "ev AS MATERIALIZED (SELECT user_id AS sender, (props->>'$.k')::BIGINT AS receiver FROM events)",
            _members("ev"), body="SELECT account, component FROM members",
        ),
        "stream_stats": _recursive(events, _members(), STATS, body="SELECT component, accounts, edges::BIGINT AS edges FROM rated"),
        "stream_alerts": _recursive(events, _large_scored(1 << 12), body=alerts.replace("epoch(ts)::DOUBLE", "epoch_us(ts) / 1e6")),
        "stream_lagged": f"WITH {events} SELECT seq, epoch_us(ts) / 1e6 AS tnum, sender, receiver, amount FROM txn",
        "stream_refined": _recursive(
            dense,
            """cut AS (SELECT b, (b + 1) * n // 3 AS last, n // 6 AS w
  FROM (SELECT count(*) AS n FROM txn), (SELECT unnest([0, 1, 2]) AS b))""",
            """way AS MATERIALIZED (SELECT DISTINCT b, sender AS u, receiver AS v FROM cut JOIN txn ON seq <= last AND seq > last - w
  WHERE sender <> receiver)""",
            "two AS MATERIALIZED (SELECT x.* FROM way x JOIN way y ON y.b = x.b AND y.u = x.v AND y.v = x.u)",
            "r(b, a, n) AS (SELECT DISTINCT b, u, u FROM two UNION SELECT r.b, r.a, two.v FROM r JOIN two ON two.b = r.b AND two.u = r.n)",
            body="SELECT b AS batch, a AS account, min(n) AS block, count(*) AS accounts FROM r GROUP BY b, a",
        ),
        "stream_windowed_flow": """
SELECT epoch(ts)::BIGINT // 86400 * 86400 AS start, user_id AS sender, count(*) AS edges,
       sum(trunc(greatest(1.0, value))::BIGINT)::BIGINT AS outflow FROM events GROUP BY ALL""",
    }
