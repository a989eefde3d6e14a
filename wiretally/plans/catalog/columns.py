"""Queries over column functions: names, addresses, statistics, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretally.functions import net, stats, text
from wiretally.operators import features as ft
from wiretally.params import DEFAULT
from wiretally.plans.catalog import sqltext as q
from wiretally.plans.catalog.registry import query, r6, table
from wiretally.sources.event_flows import read_flows

_HOSTS = "hosts AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS d FROM pages)"


def _hosts(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("d"))


def _lexical_sql(src: str, key: str, exact: bool = False) -> tuple[str, str]:
    shown = (lambda e, n: f"CAST({e} AS DOUBLE) AS {n}") if exact else q.r6
    body = f"""
lab AS (SELECT {key}, d, list_filter(string_split(d, '.'), lambda x: x <> '') AS p FROM {src}),
pay AS (SELECT *, CASE WHEN len(p) > 2 THEN array_to_string(p[1:len(p)-2], '') ELSE coalesce(p[1], '') END AS payload FROM lab),
bod AS (SELECT *, CASE WHEN payload = '' THEN d ELSE payload END AS body FROM pay),
chr AS (SELECT {key}, unnest(string_split(body, '')) AS ch, length(body) AS n FROM bod),
cent AS (SELECT {key}, -sum(c / n * log2(c / n)) AS h FROM (SELECT {key}, ch, CAST(count(*) AS DOUBLE) AS c, CAST(any_value(n) AS DOUBLE) AS n FROM chr WHERE ch <> '' GROUP BY {key}, ch) GROUP BY {key})"""
    cols = [
        ("length(d)", "dns_domain_length"), ("len(p)", "dns_label_count"),
        ("coalesce(list_max(list_transform(p, lambda x: length(x))), 0)", "dns_longest_label_length"),
        ("greatest(0, len(p) - 2)", "dns_subdomain_depth"), ("length(payload)", "dns_payload_length"),
        ("coalesce(list_sum(list_transform(p[greatest(1, len(p)-1):], lambda x: length(x))), 0)", "dns_suffix_length"),
        ("coalesce(h, 0)", "dns_char_entropy"),
        ("length(regexp_replace(body, '[^0-9]', '', 'g')) / length(body)", "dns_digit_ratio"),
        ("CASE WHEN length(regexp_replace(body, '[^a-zA-Z]', '', 'g')) > 0 THEN length(regexp_replace(body, '[^aeiou]', '', 'g')) / length(regexp_replace(body, '[^a-zA-Z]', '', 'g')) ELSE 0 END", "dns_vowel_ratio"),
        ("len(list_distinct(string_split(body, ''))) / length(body)", "dns_unique_char_ratio"),
        ("length(regexp_replace(body, '[^0-9a-f]', '', 'g')) / length(body)", "dns_hex_ratio"),
        ("coalesce(list_max(list_transform(regexp_extract_all(body, '[b-df-hj-np-tv-zA-Z]+'), lambda x: length(x))), 0)", "dns_longest_consonant_run"),
        ("length(d) - length(replace(d, '-', ''))", "dns_hyphen_count"),
        ("CASE WHEN regexp_matches(body, '[0-9]') THEN 1 ELSE 0 END", "dns_digit_present"),
    ]
    return body, f"SELECT {key}, " + ", ".join(shown(e, n) for e, n in cols) + f" FROM bod LEFT JOIN cent USING ({key})"


_b, _s = _lexical_sql("hosts", "page_id")


@query("F1 F2 F3 F4 F5 F6 F7 F8 P7", f"WITH {_HOSTS}, {_b} {_s}")
def dns_lexical_features(spark, sf):
    h = _hosts(spark, sf)
    cols = text.dns_lexical(F.col("d"))
    return h.select("page_id", *[r6(c, n) for n, c in cols.items()])


_WORDS = """words AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]+'))) AS w FROM documents)"""


@query("V13 V10 F7", f"""WITH {_WORDS}, c AS (SELECT w, lower(regexp_replace(trim(w), '\\.+$', '')) AS name FROM words)
SELECT w, CASE WHEN length(name) <= 253 AND regexp_matches(name, '^[a-z0-9_*-]{{1,63}}(\\.[a-z0-9_*-]{{1,63}})*$') THEN name END AS canonical FROM c""")
def canonical_domains(spark, sf):
    d = table(spark, sf, "documents")
    w = d.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_.-]+"), F.lit(0))).alias("w")).select(F.lower("w").alias("w")).distinct()
    return w.select("w", text.canonical_domain(F.col("w")).alias("canonical"))


@query("F1 F2 F3 F4 F5 F6", f"""WITH {_WORDS}, w2 AS (SELECT w FROM words),
chr AS (SELECT w, unnest(string_split(w, '')) AS ch FROM w2),
ent AS (SELECT w, -sum(c / n * log2(c / n)) AS h FROM (SELECT w, ch, CAST(count(*) AS DOUBLE) AS c, CAST(length(w) AS DOUBLE) AS n FROM chr WHERE ch <> '' GROUP BY w, ch) GROUP BY w)
SELECT w, {q.r6('h', 'entropy')}, {q.r6("length(regexp_replace(w, '[^0-9]', '', 'g')) / length(w)", 'digits')},
{q.r6("len(list_distinct(string_split(w, ''))) / length(w)", 'uniq')},
{q.r6("coalesce(list_max(list_transform(regexp_extract_all(w, '[b-df-hj-np-tv-zA-Z]+'), lambda x: length(x))), 0)", 'consonants')}
FROM w2 JOIN ent USING (w)""")
def word_statistics(spark, sf):
    d = table(spark, sf, "documents")
    w = d.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9_.-]+"), F.lit(0))).alias("w")).select(
        F.lower("w").alias("w")).distinct()
    c = F.col("w")
    return w.select("w", r6(text.char_entropy(c), "entropy"), r6(text.digit_ratio(c), "digits"),
                    r6(text.unique_char_ratio(c), "uniq"), r6(text.longest_consonant_run(c), "consonants"))


@query("V4 P4 P5 F23", "WITH " + q.flows() + """
SELECT event_id, CAST(string_split(dst_ip, '.')[1] AS BIGINT) * 16777216 + CAST(string_split(dst_ip, '.')[2] AS BIGINT) * 65536
  + CAST(string_split(dst_ip, '.')[3] AS BIGINT) * 256 + CAST(string_split(dst_ip, '.')[4] AS BIGINT) AS dst_number,
  dst_ip LIKE '10.%' AS dst_internal, dst_ip LIKE '10.%' AS dst_private,
  CASE WHEN dst_ip LIKE '10.%' THEN 'INTERNAL' ELSE 'OUTBOUND' END AS direction FROM flows""")
def address_facts(spark, sf):
    f = read_flows(spark, sf)
    inside = lambda c: net.in_networks(F.col(c), DEFAULT.home_networks)
    return f.select(
        "event_id", net.v4_number(F.col("dst_ip")).alias("dst_number"), inside("dst_ip").alias("dst_internal"),
        net.is_private(F.col("dst_ip")).alias("dst_private"), net.direction(inside("src_ip"), inside("dst_ip")).alias("direction"),
    )


@query("P1 P2 P3", "WITH " + q.flows() + """
SELECT event_id, orig_bytes + coalesce(resp_bytes, 0) AS total_bytes, orig_packets + coalesce(resp_packets, 0) AS total_packets,
 connection_state = 'S0' AND transport = 'tcp' AS syn_only,
 connection_state = 'S0' OR (coalesce(resp_packets, 0) = 0 AND coalesce(resp_bytes, 0) = 0) AS failed FROM flows""")
def flow_predicates(spark, sf):
    return read_flows(spark, sf).select(
        "event_id", net.total_bytes().alias("total_bytes"), net.total_packets().alias("total_packets"),
        net.is_syn_only().alias("syn_only"), net.is_failed().alias("failed"),
    )


@query("P8", "WITH " + q.entities() + " SELECT entity_kind, entity_id, event_id FROM ent")
def entity_fan_out(spark, sf):
    from wiretally.operators.entities import entity_rows

    return entity_rows(read_flows(spark, sf).select("src_ip", "dst_ip", "event_id")).select("entity_kind", "entity_id", "event_id")


@query("F12 F17 F18 F22", f"""SELECT l_orderkey, l_linenumber, {q.r6(q.exceed('l_quantity', '10'), 'quantity_strength')},
{q.r6(q.exceed('l_extendedprice', '20000', '1.4'), 'price_strength')}, {q.r6(q.ratio('l_extendedprice', 'l_discount'), 'price_per_discount')},
{q.r6('greatest(0, least(1, l_tax * 20))', 'clamped')} FROM lineitem""")
def exceedance_and_ratio(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select(
        "l_orderkey", "l_linenumber", r6(stats.exceedance(F.col("l_quantity"), 10), "quantity_strength"),
        r6(stats.exceedance(F.col("l_extendedprice"), 20000, 1.4), "price_strength"),
        r6(stats.ratio(F.col("l_extendedprice"), F.col("l_discount")), "price_per_discount"),
        r6(stats.clamp01(F.col("l_tax") * 20), "clamped"),
    )


@query("F19", """SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS rank,
 list_extract(['INFO','LOW','MEDIUM','HIGH','CRITICAL'], least(5, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) + 1)) AS escalated FROM orders""")
def severity_ladder(spark, sf):
    o = table(spark, sf, "orders")
    sev = stats.severity_name(F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return o.select("o_orderkey", stats.severity_rank(sev).alias("rank"), stats.escalate(sev).alias("escalated"))


_SCI = "format('{:.2e}', CAST(v AS DOUBLE))"


@query("F20", f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v FROM lineitem),
s AS (SELECT *, {_SCI} AS sci FROM x)
SELECT l_orderkey, l_linenumber, CASE WHEN v >= 1000 THEN
  rtrim(rtrim(substr(sci, 1, 4), '0'), '.') || substr(sci, 5) ELSE rtrim(rtrim(format('{{:.2f}}', CAST(v AS DOUBLE)), '0'), '.') END AS shown FROM s""")
def compact_numbers(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.select("l_orderkey", "l_linenumber", stats.compact_number(F.col("l_extendedprice")).alias("shown"))


@query("A1 A2 A7 A8 F13", f"""SELECT l_returnflag, l_linestatus, count(*) AS n, {q.r6('sum(l_quantity)', 'total')}, {q.r6('avg(l_discount)', 'mean')},
count(DISTINCT l_suppkey) AS suppliers, {q.r6('stddev_pop(l_quantity)', 'stdev')}, {q.r6('stddev_pop(l_quantity) / avg(l_quantity)', 'cv')},
{q.r6('quantile_cont(l_quantity, 0.5)', 'median')}, {q.r6('quantile_cont(l_extendedprice, 0.95)', 'p95')} FROM lineitem GROUP BY ALL""")
def group_statistics(spark, sf):
    l = table(spark, sf, "lineitem")
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), r6(F.sum("l_quantity"), "total"), r6(F.avg("l_discount"), "mean"),
        F.count_distinct("l_suppkey").alias("suppliers"), r6(F.stddev_pop("l_quantity"), "stdev"),
        r6(stats.cv(F.avg("l_quantity"), F.stddev_pop("l_quantity")), "cv"),
        r6(F.percentile("l_quantity", F.lit(0.5)), "median"), r6(F.percentile("l_extendedprice", F.lit(0.95)), "p95"),
    )


@query("A3 A4 A5 A6", f"""WITH c AS (SELECT l_shipmode, l_suppkey, CAST(count(*) AS DOUBLE) AS c FROM (SELECT l_returnflag AS l_shipmode, l_suppkey FROM lineitem) GROUP BY ALL)
SELECT l_shipmode AS grp, {q.r6('log2(sum(c)) - sum(c * log2(c)) / sum(c)', 'bits')},
{q.r6('CASE WHEN count(*) > 1 THEN (log2(sum(c)) - sum(c * log2(c)) / sum(c)) / log2(count(*)) ELSE 0 END', 'norm')},
{q.r6('max(c) / sum(c)', 'top_share')} FROM c GROUP BY l_shipmode""")
def group_entropy(spark, sf):
    c = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("grp"), "l_suppkey").agg(F.count("*").alias("c"))
    bits = stats.entropy_from(F.sum("c"), F.sum(stats.xlog2x(F.col("c"))))
    return c.groupBy("grp").agg(
        r6(bits, "bits"), r6(stats.normalised_entropy(bits, F.count("*")), "norm"), r6(F.max("c") / F.sum("c"), "top_share")
    )


_DNS_SQL = "WITH RECURSIVE " + q.entities() + ", dq AS (SELECT event_id, dns_query AS d, dns_qtype, dns_rcode, dns_resp FROM flows WHERE dns_query IS NOT NULL)"
_b2, _s2 = _lexical_sql("dq", "event_id")


@query("F9 F10 P6 P7 U3", _DNS_SQL + f""", {_b2}, lx AS ({_s2}),
rd AS (SELECT 'HOST' AS entity_kind, src_ip AS entity_id, ts_us, event_id AS read FROM flows WHERE dns_query IS NOT NULL),
{q.window_totals((60,), 'rd').strip()}
SELECT t.entity_id AS host, t.read AS event_id, lx.dns_domain_length, lx.dns_char_entropy, lx.dns_hex_ratio, lx.dns_payload_length, lx.dns_subdomain_depth,
 {q.r6("CASE WHEN dns_qtype = 'TXT' THEN 1 ELSE 0 END", 'dns_is_txt')}, {q.r6("CASE WHEN dns_rcode = 'NXDOMAIN' THEN 1 ELSE 0 END", 'dns_is_nxdomain')},
 {q.r6(q.ratio('dns_resp', 'length(d)'), 'dns_request_response_asymmetry')}, {q.r6('v_dns_60', 'dns_query_count_60s')},
 {q.r6(q.ratio('u_name_60', 'v_dns_60', '1.0'), 'dns_unique_name_ratio_60s')}, {q.r6(q.ratio('v_txt_60', 'v_dns_60', '1.0'), 'dns_txt_ratio_60s')}
FROM tot t JOIN dq ON dq.event_id = t.read JOIN lx ON lx.event_id = t.read""")
def dns_query_vectors(spark, sf):
    v = ft.vectors(read_flows(spark, sf), DEFAULT.with_(flush_at="none"), ["flow_count_1s"], protocol=True, dns_sizes=(60,), kinds=("HOST",))
    d = ft.dns_vectors(v)
    names = (
        "dns_domain_length", "dns_char_entropy", "dns_hex_ratio", "dns_payload_length", "dns_subdomain_depth", "dns_is_txt",
        "dns_is_nxdomain", "dns_request_response_asymmetry", "dns_query_count_60s", "dns_unique_name_ratio_60s", "dns_txt_ratio_60s",
    )
    return d.select(F.col("entity_id").alias("host"), "event_id", *[r6(n) for n in names])


@query("F11 U3", "WITH " + q.entities(True) + f""",
arr AS (SELECT entity_kind, entity_id, ts_us, event_id, (ts_us - lag(ts_us) OVER w) / 1e6 AS gap FROM ent WHERE entity_kind = 'PAIR'
        WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY ts_us)),
g AS (SELECT event_id, coalesce(avg(gap) OVER w, 0) AS m, coalesce(stddev_pop(gap) OVER w, 0) AS sd, count(gap) OVER w AS n FROM arr
      WINDOW w AS (PARTITION BY entity_kind, entity_id ORDER BY ts_us ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)),
t AS (SELECT *, CASE WHEN m > 0 THEN sd / m ELSE 0 END AS cv FROM g JOIN fe USING (event_id) WHERE sni IS NOT NULL)
SELECT event_id, {q.r6('v_out + v_in', 'tls_session_bytes')}, {q.r6('v_packets', 'tls_session_packets')}, {q.r6('duration', 'tls_session_duration')},
{q.r6(q.ratio('(v_out + v_in)', 'v_packets'), 'tls_mean_packet_size')}, {q.r6(q.ratio('v_out', 'v_in'), 'tls_orig_resp_byte_ratio')},
{q.r6('30 + k', 'tls_cert_validity_days')}, {q.r6('CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END', 'tls_self_signed')}, {q.r6('length(sni)', 'tls_sni_length')},
{q.r6('rarity', 'destination_rarity')}, {q.r6('cv', 'interarrival_cv')},
{q.r6('CASE WHEN n > 0 THEN greatest(0, 1 - least(1, cv)) * least(1, n / 6.0) ELSE 0 END', 'periodicity_score')} FROM t""")
def tls_handshake_vectors(spark, sf):
    v = ft.vectors(read_flows(spark, sf, True), DEFAULT.with_(flush_at="none"), ["flow_count_1s"], protocol=True, dns_sizes=(60,), kinds=("PAIR",))
    names = (
        "tls_session_bytes", "tls_session_packets", "tls_session_duration", "tls_mean_packet_size", "tls_orig_resp_byte_ratio",
        "tls_cert_validity_days", "tls_self_signed", "tls_sni_length", "destination_rarity", "interarrival_cv", "periodicity_score",
    )
    return ft.tls_vectors(v).select("event_id", *[r6(n) for n in names])


@query("F21", "WITH " + q.entities() + """
SELECT src_ip, dst_ip, transport, service, CAST(dst_port AS VARCHAR) AS dst_port, count(*) AS n FROM fe GROUP BY ALL""")
def vector_labels(spark, sf):
    f = read_flows(spark, sf).withColumn("read", F.lit("emit")).withColumn("l", ft.windowed_labels())
    return f.groupBy(*[F.col("l")[k].alias(k) for k in ("src_ip", "dst_ip", "transport", "service", "dst_port")]).agg(F.count("*").alias("n"))


