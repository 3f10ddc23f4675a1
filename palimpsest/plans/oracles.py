"""DuckDB SQL for the catalogue's queries."""

from __future__ import annotations

import math

_LOG = """log AS (SELECT CAST(user_id AS VARCHAR) AS k, event_id + 1 AS seq, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS op,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS v, event_id // 500 AS run FROM events)"""


def _latest(source: str = "log", by: str = "k", order: str = "seq DESC") -> str:
    return f"SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS rn FROM {source}) WHERE rn = 1"


def _over_log(query: str, *more: str) -> str:
    return f"WITH {', '.join([_LOG, f'top AS ({_latest()})', *more])} {query}"


_FLUSHED = f"flushed AS ({_latest(by='run, k')})"
_INDEX = "idx AS (SELECT secondary, prim, op FROM (SELECT o_orderpriority AS secondary, o_custkey + {shift} AS prim, {op} AS op, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)"
_IDX = _INDEX.format(shift=0, op=1)
_ENCODED = "e AS (SELECT p_partkey AS id, concat_ws('|', p_name, p_type, printf('%.2f', p_retailprice)) AS encoded FROM part), f AS (SELECT *, list_filter(string_split(encoded, '|'), lambda x: x <> '') AS f FROM e)"

_M = 4294967295
_BYTES = "list_transform(generate_series(1, octet_length(encode(k))), lambda i: CAST('0x' || substr(hex(encode(k)), 2 * i - 1, 2) AS BIGINT))"


def _times(x: str, c: int) -> str:
    return f"((({x}) & 65535) * {c} + ((((({x}) >> 16) * {c}) & 65535) << 16)) & {_M}"


def _finish(name: str, of: str) -> str:
    """Stages of one hash, each a step of its own so that nothing is written out twice."""
    return (
        f"{name}a AS (SELECT k, xor(x, x >> 16) AS x FROM {of}), {name}b AS (SELECT k, {_times('x', 0x85EBCA6B)} AS x FROM {name}a), {name}c AS (SELECT k, xor(x, x >> 13) AS x FROM {name}b), "
        f"{name}d AS (SELECT k, {_times('x', 0xC2B2AE35)} AS x FROM {name}c), {name} AS (SELECT k, xor(x, x >> 16) AS h FROM {name}d)"
    )


_FNV = f"((xor(a, b) * 16777619) & {_M})"


def _hashes(keys: str = "SELECT DISTINCT k FROM log") -> str:
    """Both hashes of keys."""
    return ", ".join([
        f"keys AS ({keys})",
        f"one0 AS (SELECT k, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {_BYTES}), lambda a, b: {_FNV}) AS x FROM keys)", _finish("one", "one0"),
        f"two0 AS (SELECT k, list_reduce(list_prepend(CAST({0x811C9DC5 ^ 0x9E3779B9} AS BIGINT), {_BYTES}), lambda a, b: (({_FNV} << 5) | ({_FNV} >> 27)) & {_M}) AS x FROM keys)", _finish("two", "two0"),
        "hashes AS (SELECT k, one.h AS h1, two.h AS h2 FROM one JOIN two USING (k))",
    ])


#: Bits, and hashes, of a filter for n keys at one in a hundred.
_FULL = f"greatest(8, CAST(ceil(-n * ({math.log(0.01)!r})::DOUBLE / ({math.log(2) ** 2!r})::DOUBLE) AS BIGINT))"
_SIZED = f"({_FULL} + 7) // 8 * 8 AS bits, CAST(least(30, greatest(1, floor(CAST({_FULL} AS DOUBLE) / n * ({math.log(2)!r})::DOUBLE + 0.5))) AS BIGINT) AS hashes"
#: The filter of all keys of the log: its size, its bits.
_ALL = (
    f"sized AS (SELECT {_SIZED} FROM (SELECT count(DISTINCT k) AS n FROM log))",
    f"hit AS (SELECT DISTINCT k, bits, hashes, ((h1 + i * h2) & {_M}) % bits AS pos FROM (SELECT * FROM hashes, sized), generate_series(0, 29) g(i) WHERE i < hashes)",
    "bits AS (SELECT DISTINCT pos FROM hit WHERE k IN (SELECT k FROM log))",
)


def _le(x: str, size: int) -> str:
    return " || ".join(f"lpad(lower(to_hex(({x} >> {8 * i}) & 255)), 2, '0')" for i in range(size))


#: CRC-32 of the bytes whose digits are b: a list of each byte and seven zeros, each a step by one bit.
_BITS = "flatten(list_transform(generate_series(1, CAST(length(b) // 2 AS BIGINT)), lambda i: [CAST('0x' || substr(b, CAST(2 * i - 1 AS BIGINT), 2) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
_CRC = f"xor(list_reduce(list_prepend(CAST({_M} AS BIGINT), {_BITS}), lambda c, e: xor(xor(c, e) >> 1, {0xEDB88320} * (xor(c, e) & 1))), {_M})"

SQL = {
    "get_raw": _over_log("SELECT k, seq, op, v FROM top"),
    "get": _over_log("SELECT k, seq, v FROM top WHERE op = 1 AND k = '42'"),
    "live": _over_log("SELECT k, seq, v FROM top WHERE op = 1"),
    "tombstones": _over_log("SELECT k, seq FROM top WHERE op = 0"),
    "multi_get": _over_log("SELECT q.k, CASE WHEN l.k IS NULL THEN 'NOT_FOUND' ELSE 'OK' END AS status, l.v FROM (SELECT CAST(i AS VARCHAR) AS k FROM range(200) r(i)) q LEFT JOIN (SELECT * FROM top WHERE op = 1) l USING (k)"),
    "snapshot_5000": f"WITH {_LOG}, s AS (SELECT * FROM log WHERE seq <= 5000) SELECT k, seq, v FROM ({_latest('s')}) WHERE op = 1",
    "snapshot_diff": f"""WITH {_LOG}, a AS (SELECT * FROM log WHERE seq <= 3000), b AS (SELECT * FROM log WHERE seq <= 7000),
        o AS (SELECT k, v FROM ({_latest("a")}) WHERE op = 1), n AS (SELECT k, v FROM ({_latest("b")}) WHERE op = 1)
        SELECT coalesce(o.k, n.k) AS k, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' ELSE 'changed' END AS change, o.v AS old_value, n.v AS new_value
        FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.v IS DISTINCT FROM n.v""",
    "iter_all": _over_log("SELECT k, seq, op, v, CAST(row_number() OVER (PARTITION BY k ORDER BY seq DESC) AS INTEGER) AS version FROM log"),
    "version_counts": _over_log("SELECT k, count(*) AS versions, count(*) FILTER (WHERE op = 0) AS deletes FROM log GROUP BY k"),
    "flush_runs": _over_log("SELECT run, k, seq, op, v FROM flushed", _FLUSHED),
    "run_meta": _over_log("SELECT run, min(k) AS min_key, max(k) AS max_key, count(*) AS entries, count(*) FILTER (WHERE op = 0) AS deletes, min(seq) AS min_seq, max(seq) AS max_seq FROM flushed GROUP BY run", _FLUSHED),
    "run_scan": _over_log("SELECT k, seq, op, v FROM flushed WHERE run = 3", _FLUSHED),
    "compact": _over_log(f"SELECT k, seq, v FROM ({_latest('flushed', 'k', 'run DESC, seq DESC')}) WHERE op = 1", _FLUSHED),
    "compact_stats": _over_log(f"SELECT (SELECT count(*) FROM flushed) AS rows_in, count(*) AS keys, count(*) FILTER (WHERE op = 1) AS rows_out FROM ({_latest('flushed', 'k', 'run DESC, seq DESC')})", _FLUSHED),
    "logical_size": _over_log("SELECT count(*) AS entries, CAST(sum(octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) + 17) AS BIGINT) AS bytes FROM log"),
    "index_get": f"WITH {_IDX} SELECT secondary, prim, c_name FROM idx JOIN customer ON prim = c_custkey",
    "index_phantom": f"WITH {_INDEX.format(shift=1000, op=1)} SELECT secondary, prim FROM idx ANTI JOIN customer ON prim = c_custkey",
    "index_semi": f"WITH {_INDEX.format(shift=1000, op=1)} SELECT secondary, prim FROM idx SEMI JOIN customer ON prim = c_custkey",
    "index_lookup_primary": f"WITH {_IDX} SELECT secondary, prim FROM idx",
    "index_delete": f"WITH {_INDEX.format(shift=0, op="CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END")} SELECT secondary, prim FROM idx WHERE op = 1",
    "index_delete_removed": "SELECT o_custkey AS secondary, max(o_orderkey) AS prim FROM orders GROUP BY 1 HAVING max_by(o_orderstatus, o_orderkey) <> 'O'",
    "index_multi": "SELECT o_orderpriority AS secondary, count(DISTINCT o_custkey) AS entries, max(o_orderkey) AS last_seq FROM orders GROUP BY 1",
    "codec_roundtrip": f"WITH {_ENCODED} SELECT id, encoded, coalesce(f[1], '?') AS name, coalesce(f[2], '?') AS category, coalesce(f[3], '?') AS price, coalesce(f[4], '?') AS missing FROM f",
    "find_category": f"WITH {_ENCODED} SELECT id, f[1] AS name, f[2] AS category FROM f WHERE f[2] = 'ECONOMY'",
    "range_scan": _over_log("SELECT k, seq, v FROM top WHERE op = 1 AND k >= '10' AND k < '12'"),
    "list_count": _over_log("SELECT count(*) AS n, min(k) AS first_key, max(k) AS last_key FROM top WHERE op = 1"),
    "cli_session": """WITH l AS (SELECT concat_ws(',', printf('P%03d', p_partkey), p_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END, printf('%.2f', p_retailprice) || CASE WHEN p_partkey % 11 = 0 THEN ',extra' ELSE '' END) AS line FROM part),
        f AS (SELECT list_filter(string_split(line, ','), lambda x: x <> '') AS f FROM l), n AS (SELECT count(*) FILTER (WHERE len(f) >= 4) AS loaded, count(*) FILTER (WHERE len(f) < 4) AS bad, count(*) FILTER (WHERE f[3] = 'ECONOMY' AND len(f) >= 4) AS found FROM f)
        SELECT s.step, s.command, CASE s.step WHEN 0 THEN loaded || ' loaded, ' || bad || ' errors' WHEN 1 THEN loaded || ' found' WHEN 2 THEN found || ' found' WHEN 3 THEN (SELECT f[2] || '|' || f[3] || '|' || f[4] FROM f WHERE f[1] = 'P001')
        WHEN 4 THEN 'OK' WHEN 5 THEN 'NOT_FOUND' WHEN 6 THEN 'OK' WHEN 7 THEN 'a|b|1' WHEN 8 THEN '1 runs' ELSE loaded || ' found' END AS line
        FROM n, (VALUES (0, 'load'), (1, 'list'), (2, 'find'), (3, 'get'), (4, 'del'), (5, 'get'), (6, 'put'), (7, 'last'), (8, 'compact'), (9, 'snap')) s(step, command)""",
    "csv_load": """WITH l AS (SELECT concat_ws(',', printf('P%03d', p_partkey), p_name, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_type END, printf('%.2f', p_retailprice) || CASE WHEN p_partkey % 11 = 0 THEN ',extra' ELSE '' END) AS line FROM part),
        f AS (SELECT list_filter(string_split(line, ','), lambda x: x <> '') AS f FROM l)
        SELECT f[1] AS id, f[2] AS name, f[3] AS category, f[4] AS price FROM f WHERE len(f) >= 4""",
    "product_ids": "SELECT p_partkey, printf('P%03d', p_partkey) AS id FROM part",
    "any_live": _over_log("SELECT count(*) > 0 AS any_live FROM top WHERE op = 1"),
    "wal_bytes_prefix": _over_log("SELECT run, row_number() OVER (PARTITION BY run ORDER BY seq) - 1 AS place, op, k, v FROM log WHERE seq < (SELECT least(max(seq), coalesce(min(seq) FILTER (WHERE seq % 7777 = 0), 9223372036854775807)) FROM log)"),
    "crc32_record": _over_log(f"SELECT seq, {_CRC} AS crc FROM body", f"body AS (SELECT seq, lpad(lower(to_hex(op)), 2, '0') || {_le('octet_length(encode(k))', 4)} || {_le('coalesce(octet_length(encode(v)), 0)', 4)} || hex(encode(k)) || hex(encode(coalesce(v, ''))) AS b FROM log)"),
    "run_record_decode": _over_log("SELECT seq, op, k, v FROM log"),
    "run_blocks": _over_log(
        "SELECT run, list_reduce(list_prepend(CAST(1048576 AS BIGINT), sizes), lambda s, n: CASE WHEN s % 1048576 + n > 4088 THEN (s // 1048576 + 1) * 1048576 + n ELSE s + n END) // 1048576 AS blocks FROM s", _FLUSHED,
        "s AS (SELECT run, list(17 + octet_length(encode(k)) + coalesce(octet_length(encode(v)), 0) ORDER BY k) AS sizes FROM flushed GROUP BY run)",
    ),
    "wal_valid_prefix": _over_log("SELECT k, seq, op FROM log WHERE seq < (SELECT coalesce(min(seq), 9223372036854775807) FROM log WHERE seq % 7777 = 0)"),
    "wal_crc_prefix": _over_log("SELECT k, seq, op FROM log WHERE seq < (SELECT coalesce(min(seq), 9223372036854775807) FROM log WHERE seq % 7777 = 0)"),
    "run_record": _over_log(f"SELECT seq, lpad(lower(to_hex(op)), 2, '0') || {_le('seq', 8)} || {_le('octet_length(encode(k))', 4)} || {_le('coalesce(octet_length(encode(v)), 0)', 4)} || lower(hex(encode(k))) || lower(hex(encode(coalesce(v, '')))) AS record FROM log"),
    "bloom_hash": _over_log("SELECT k, h1, h2 FROM hashes", _hashes()),
    "bloom_build": _over_log(
        f"SELECT DISTINCT run, ((h1 + i * h2) & {_M}) % bits AS pos FROM (SELECT DISTINCT run, k FROM log) JOIN hashes USING (k) JOIN sized USING (run), generate_series(0, 29) g(i) WHERE i < hashes",
        _hashes(), f"sized AS (SELECT run, {_SIZED} FROM (SELECT run, count(DISTINCT k) AS n FROM log GROUP BY run))",
    ),
    "bloom_probe": _over_log("SELECT k, bool_and(pos IN (SELECT pos FROM bits)) AS may_contain FROM hit WHERE k IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer) GROUP BY k", _hashes("SELECT k FROM log UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer"), *_ALL),
    "bloom_bytes": _over_log(
        f"SELECT bits, hashes, {_le('bits', 4)} || {_le('hashes', 4)} || (SELECT string_agg(lpad(lower(to_hex(b)), 2, '0'), '' ORDER BY byte) FROM (SELECT byte, coalesce(sum(1 << (pos % 8)), 0)::BIGINT AS b FROM sized, generate_series(0, bits // 8 - 1) g(byte) LEFT JOIN bits ON pos // 8 = byte GROUP BY byte)) AS stored FROM sized",
        _hashes(), *_ALL,
    ),
    "bloom_sizing": """SELECT n, fpr, (CAST(m AS BIGINT) + 7) // 8 * 8 AS bits, CAST(least(30, greatest(1, round(m / n * ln(2)))) AS BIGINT) AS hashes
        FROM (SELECT n, fpr, greatest(8, ceil(-n * ln(fpr) / (ln(2) * ln(2)))) AS m FROM (VALUES (1::BIGINT, 0.01::DOUBLE), (100, 0.01), (500, 0.01), (1000, 0.01), (10000, 0.01), (1000000, 0.001)) t(n, fpr))""",
    "as_of_join": f"""WITH {_LOG} SELECT p.k, p.at_seq AS "at", coalesce(l.seq, -1) AS seq, coalesce(l.op, -1) AS op, l.v
        FROM (SELECT CAST(o_custkey AS VARCHAR) AS k, o_orderkey AS at_seq FROM orders) p ASOF LEFT JOIN log l ON p.k = l.k AND p.at_seq >= l.seq""",
    "live_by_nation": _over_log("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM top JOIN customer ON k = CAST(c_custkey AS VARCHAR) JOIN nation ON c_nationkey = n_nationkey WHERE op = 1 GROUP BY n_name"),
    "status_names": "SELECT i AS id, CASE WHEN i BETWEEN 0 AND 6 THEN ['OK', 'NOT_FOUND', 'IO_ERROR', 'CORRUPTION', 'OOM', 'BUSY', 'INVALID_ARG'][i + 1] ELSE 'UNKNOWN' END AS name FROM range(-1, 9) r(i)",
    "byte_order": "SELECT s, encode(s) < encode('m') AS below_m, encode(s) = encode('') AS is_empty, CAST(octet_length(encode(s)) AS BIGINT) AS n_bytes FROM (SELECT DISTINCT unnest([p_name, substr(p_name, 1, 3), '']) AS s FROM part)",
    "stream_live": _over_log("SELECT k, seq, v FROM top WHERE op = 1"),
    "store_live": _over_log("SELECT k, seq, v FROM top WHERE op = 1"),
    "store_runs": _over_log("""SELECT run, count(*) AS entries, count(*) FILTER (WHERE op = 0) AS deletes, min(seq) AS min_seq, max(seq) AS max_seq, CAST(max(most) AS BIGINT) AS current_seq
        FROM (SELECT seq, op, most, CASE WHEN seq <= most // 3 THEN 1 WHEN seq <= most * 2 // 3 THEN 2 ELSE 3 END AS run FROM log, (SELECT max(seq) AS most FROM log)) GROUP BY run"""),
    "store_two_writers": _over_log("SELECT k, v FROM top WHERE op = 1"),
    "store_snapshot": f"WITH {_LOG}, s AS (SELECT * FROM log WHERE seq <= (SELECT max(seq) // 2 FROM log)) SELECT k, seq, v FROM ({_latest('s')}) WHERE op = 1",
    "store_index": "SELECT c_name AS secondary, CAST(c_custkey AS VARCHAR) AS prim, c_mktsegment AS v FROM customer WHERE c_acctbal >= 0",
}
