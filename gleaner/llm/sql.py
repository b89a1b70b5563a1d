"""DuckDB twins of the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op7_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
p AS (SELECT k, i, array_to_string(list_slice(w, i, i + 7), ' ') AS g
      FROM (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM p),
s AS (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS j FROM r WHERE c > 1),
n AS (SELECT k, sum(least(8, coalesce(j - i, 8))) AS m FROM s GROUP BY k),
b AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(l) AS BIGINT) AS lines,
         CAST(coalesce(m, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN n USING (k))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words
            OR 10 * n_symbols > 3 * n_words
            OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 5 * greatest(lines, 1)) AS kept
FROM b
"""

SQL["op1_url_rules"] = r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS k FROM pages),
a AS (SELECT *, regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1) AS h, regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT *, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM a),
r(rule, own, rest, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
l AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
      FROM b JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, rest) GROUP BY k),
t AS (SELECT *, list_sort(list_distinct(list_concat(list_concat(
        list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
        list_transform(list_filter(flatten(list_transform(list_filter(string_split(host, '.'), lambda x: contains(x, '-')), lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'w:' || x)),
        list_transform(list_filter(string_split(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '/'),
                       lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'p:' || x)))) AS tok FROM b),
m AS (SELECT k, page_id, tok, unnest(range(1, CAST(pow(2, len(tok)) AS BIGINT))) AS mask FROM t),
s AS (SELECT k, page_id, array_to_string(list_filter(tok, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS items FROM m),
g AS (SELECT doc_id, bool_or(quality = 0 OR toxic = 1) AS bad FROM labels GROUP BY doc_id),
n AS (SELECT count(*) AS n FROM t JOIN g ON page_id = doc_id WHERE len(tok) > 0),
f AS (SELECT items, count(*) AS c, count(*) FILTER (WHERE bad) AS b FROM s JOIN g ON page_id = doc_id GROUP BY items),
x AS (SELECT items FROM f, n WHERE b >= greatest(25, (n + 199) // 200) AND 5 * b >= 3 * c),
y AS (SELECT DISTINCT k FROM s JOIN x USING (items))
SELECT page_id, host, path, l.rule, coalesce(l.verdict, CASE WHEN y.k IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM b LEFT JOIN l USING (k) LEFT JOIN y USING (k)
"""

SQL["op2_warc_archives"] = r"""
WITH p AS (SELECT page_id, row_number() OVER () AS k, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS x FROM pages),
d AS (SELECT page_id, k, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER g AS first, row_number() OVER (g ORDER BY page_id NULLS LAST, k) AS place FROM d WINDOW g AS (PARTITION BY payload_digest, payload_bytes))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first END AS refers_to FROM f
"""

SQL["op4_suffix_dedup"] = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d WHERE n >= 100)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, p) > 1),
s AS (SELECT *, CASE WHEN p > lag(p) OVER o + 100 OR lag(p) OVER o IS NULL THEN 1 ELSE 0 END AS new FROM r WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM s),
v AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS last FROM v),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * last + 1, 2 * (a - last)), '' ORDER BY a) AS kept, max(b) AS tail FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

SQL["op8_decontamination"] = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS a FROM documents),
q AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS b FROM benchmark),
z AS (SELECT item, b, least(13, len(b)) AS m, unnest(range(1, greatest(len(b) - 12, 1) + 1)) AS i FROM q WHERE len(b) > 0),
g AS (SELECT DISTINCT item, m, array_to_string(list_slice(b, i, i + m - 1), ' ') AS s FROM z),
e AS (SELECT k, a, m, unnest(range(1, len(a) - m + 2)) AS i FROM w, (SELECT DISTINCT m FROM g) WHERE len(a) >= m),
h AS (SELECT k, i, e.m, item FROM (SELECT k, i, m, array_to_string(list_slice(a, i, i + m - 1), ' ') AS s FROM e) e JOIN g ON e.m = g.m AND e.s = g.s),
c AS (SELECT k, count(DISTINCT x) AS n FROM (SELECT k, unnest(range(i, i + m)) AS x FROM h) GROUP BY k),
j AS (SELECT k, count(DISTINCT item) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT k, item FROM h) GROUP BY k)
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(j.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(j.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(a) AS contaminated
FROM w LEFT JOIN c USING (k) LEFT JOIN j USING (k)
"""

SQL["op6_byte_sharding"] = r"""
WITH t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(md5(text), '') AS key,
        list_transform(range(0, strlen(coalesce(text, ''))), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS a
      FROM (SELECT doc_id, text, hex(encode(coalesce(text, ''))) AS h FROM documents)),
c AS (SELECT doc_id, CAST(size AS BIGINT) AS size, key,
        CASE WHEN len(a) = 0 THEN 0 ELSE xor(list_reduce(a, lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END AS crc FROM b, t),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, CAST((SELECT sum(size) FROM c) AS DOUBLE) AS total FROM c),
p AS (SELECT *, least(15, floor((start + size / 2.0) * 16 / total)) AS cut FROM s),
g AS (SELECT key, CASE WHEN min(cut) < max(cut) AND sum(size) <= 0.05 * max(total) / 16 THEN least(15, floor((min(start) + sum(size) / 2.0) * 16 / max(total))) END AS whole FROM p GROUP BY key),
f AS (SELECT doc_id, size, crc, key, CAST(coalesce(whole, cut) AS INTEGER) AS shard FROM p JOIN g USING (key))
SELECT doc_id, size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY key, doc_id) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM f
"""

SQL["op5_source_mixing"] = r"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, CASE sid % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
t AS (SELECT CAST(sum(source_size) AS BIGINT) AS t, count(*) AS n FROM w),
o AS (SELECT *, coalesce(sum(cap) OVER r, 0) AS c0, coalesce(sum(weight) OVER r, 0) AS w0, sum(weight) OVER () AS w1 FROM w WINDOW r AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT ((SELECT t FROM t) - c0) / (w1 - w0) AS level, cap / weight AS r, row_number() OVER (ORDER BY cap / weight, sid) AS i FROM o),
e AS (SELECT arg_min(level, i) AS level FROM v WHERE level <= r),
g AS (SELECT source, sid, source_size, least(weight * level, cap) AS target FROM w, e),
k AS (SELECT sum(target) AS total, greatest(1, least(4096, t // greatest(50000, 200 * n))) AS length FROM g, t GROUP BY t, n),
x AS (SELECT sid, CAST(round(target / total * 1099511627776.0) AS BIGINT) AS ticks FROM g, k),
y AS (SELECT sid, ticks, coalesce(sum(ticks) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo, max(sid) FILTER (WHERE ticks > 0) OVER () AS last FROM x),
z AS (SELECT sid, lo, CASE WHEN sid = last THEN greatest(lo + ticks, 1099511627776) ELSE lo + ticks END AS hi FROM y WHERE ticks > 0),
p AS (SELECT list_sum(list_transform(range(0, 40), lambda b: ((j >> b) & 1) << (39 - b))) AS u FROM (SELECT unnest(range(0, CAST(greatest(1, round(total / length)) AS BIGINT))) AS j FROM k)),
c AS (SELECT sid, count(*) AS slots FROM z JOIN p ON u >= lo AND u < hi GROUP BY sid),
q AS (SELECT doc_id, size, source_size, target, sid, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':13'), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform([0, 1, 2], lambda r:
         greatest(0, least(size, coalesce(slots, 0) * length - off - r * source_size)))) AS BIGINT) AS taken
FROM q JOIN k ON true LEFT JOIN c USING (sid)
"""

_CRC_TABLE = "list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i))"
_CRC = """CASE WHEN len({bytes}) = 0 THEN 0 ELSE xor(list_reduce({bytes}, lambda c, x: xor(c >> 8, tab[CAST(xor(c, x) & 255 AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) END"""

SQL["op11_point_in_time"] = rf"""
WITH t AS (SELECT {_CRC_TABLE} AS tab),
b AS (SELECT *, row_number() OVER () AS k, list_transform(string_split(coalesce(CAST(sale_id AS VARCHAR), ''), ''), lambda x: CAST(ord(x) AS BIGINT)) AS a
      FROM sales WHERE client_id IS NOT NULL AND sold_at IS NOT NULL),
s AS (SELECT k, sale_id, client_id, epoch_us(sold_at) AS sold, greatest(epoch_us(sold_at), epoch_us(arrived_at) + 14400000000) AS enter, arrived_at IS NOT NULL AS known,
        CASE WHEN abs(total) < 9e15 THEN CAST(floor(100 * total + 0.5) AS BIGINT) ELSE 0 END AS cents,
        epoch_us(sold_at) + {_CRC.format(bytes="a")} % 259200 * 1000000 AS t FROM b, t),
w AS (SELECT s.*, d, CAST(d AS BIGINT) * 86400000000 AS span FROM s, (VALUES (2), (14)) v(d)),
l AS (SELECT w.k, d FROM w SEMI JOIN s ON s.client_id = w.client_id AND s.sold > w.t AND s.sold <= w.t + 604800000000),
c AS (SELECT *, epoch_us(ts) AS u, greatest(epoch_us(ts), epoch_us(arrived_at) + 14400000000) AS enter,
        CASE WHEN abs(value) < 9e15 THEN CAST(floor(100 * value + 0.5) AS BIGINT) ELSE 0 END AS cents
      FROM (SELECT DISTINCT click_id, ts, arrived_at, client_id, kind, value, props FROM clicks) WHERE ts IS NOT NULL AND arrived_at IS NOT NULL),
e AS (SELECT w.k, d, count(*) AS n, count(*) FILTER (WHERE kind = 'purchase') AS p, sum(cents_) AS m, arg_max(click_id, (u, coalesce(click_id, -4611686018427387904))) AS last
      FROM w JOIN (SELECT client_id, u, enter AS enter_, kind, cents AS cents_, click_id FROM c) c ON c.client_id = w.client_id AND c.enter_ <= w.t AND c.u > w.t - w.span GROUP BY w.k, d),
f AS (SELECT w.k, d, o.k AS ok, o.sale_id AS oid, o.cents AS m FROM w JOIN s o ON o.client_id = w.client_id AND o.known AND o.enter <= w.t AND o.sold > w.t - w.span),
g AS (SELECT k, d, count(*) AS n, sum(m) AS m FROM f GROUP BY k, d),
h AS (SELECT f.k, f.d, count(*) AS n, count(DISTINCT item_id) AS i, sum(CASE WHEN abs(amount) < 9e15 THEN CAST(floor(100 * amount + 0.5) AS BIGINT) ELSE 0 END) AS m
      FROM f JOIN w ON w.k = f.k AND w.d = f.d JOIN sale_lines x ON x.sale_id = f.oid AND epoch_us(x.shipped_at) <= w.t GROUP BY f.k, f.d)
SELECT w.sale_id, CAST(w.d AS INTEGER) AS d, CAST(w.t AS BIGINT) AS t_us, l.k IS NOT NULL AS label,
       CAST(coalesce(e.n, 0) AS BIGINT) AS n_clicks, CAST(coalesce(e.p, 0) AS BIGINT) AS n_purchases, CAST(coalesce(e.m, 0) AS BIGINT) AS click_cents, e.last AS last_click_id,
       CAST(coalesce(g.n, 0) AS BIGINT) AS n_sales, CAST(coalesce(g.m, 0) AS BIGINT) AS sale_cents,
       CAST(coalesce(h.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(h.i, 0) AS BIGINT) AS n_items, CAST(coalesce(h.m, 0) AS BIGINT) AS line_cents
FROM w LEFT JOIN l USING (k, d) LEFT JOIN e USING (k, d) LEFT JOIN g USING (k, d) LEFT JOIN h USING (k, d)
"""

_FEATURES = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
SQL["op12_importance"] = rf"""
WITH t AS (SELECT {_CRC_TABLE} AS tab),
w AS (SELECT row_number() OVER () AS k, doc_id, {_FEATURES} AS a FROM documents),
v AS (SELECT {_FEATURES} AS a FROM benchmark),
f AS (SELECT k, x, count(*) AS c FROM (SELECT k, unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[CAST(i AS BIGINT)] || ' ' || a[CAST(i + 1 AS BIGINT)]))) AS x FROM w) GROUP BY k, x),
g AS (SELECT x, count(*) AS c FROM (SELECT unnest(list_concat(a, list_transform(range(1, len(a)), lambda i: a[CAST(i AS BIGINT)] || ' ' || a[CAST(i + 1 AS BIGINT)]))) AS x FROM v) GROUP BY x),
y AS (SELECT x, list_transform(range(0, strlen(x)), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS a
      FROM (SELECT x, hex(encode(x)) AS h FROM (SELECT x FROM f UNION SELECT x FROM g))),
b AS (SELECT x, CAST({_CRC.format(bytes="a")} % 10000 AS BIGINT) AS b FROM y, t),
s AS (SELECT b, sum(c) AS s FROM f JOIN b USING (x) GROUP BY b),
r AS (SELECT b, sum(c) AS t FROM g JOIN b USING (x) GROUP BY b),
n AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS ns, coalesce((SELECT sum(t) FROM r), 0) AS nt),
q AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ns + 10000 AS DOUBLE)) / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(nt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
      FROM s FULL JOIN r USING (b), n),
m AS (SELECT k, CAST(sum(c) AS BIGINT) AS n, CAST(sum(c * gain) AS BIGINT) AS g FROM f JOIN b USING (x) JOIN q USING (b) GROUP BY k),
d AS (SELECT k, doc_id, len(a) AS words, coalesce(m.n, 0) AS n_features, CASE WHEN m.n > 0 THEN (m.g - ((m.g % m.n) + m.n) % m.n) // m.n ELSE 0 END AS weight,
        CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM w LEFT JOIN m USING (k)),
z AS (SELECT *, CAST(weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS BIGINT) AS score FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id, n_features DESC) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS able FROM z)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score, CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM p
"""
