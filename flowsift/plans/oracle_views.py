"""The test views written in plain SQL for the DuckDB oracle.

These mirror ``flowsift.sources.views`` and ``flowsift.plans.preprocess``
rule for rule; they are common table expressions to put after ``WITH``.
"""

FLOWS = r"""
flows AS (
  SELECT uid, event_time, orig_h, resp_p, proto, conn_state, service, cents,
         CASE WHEN uid % 5 = 0 THEN '-' ELSE CAST(cents AS VARCHAR) END AS duration_raw,
         CASE WHEN uid % 10 = 3 THEN NULL ELSE cents END AS orig_bytes,
         CASE WHEN uid % 4 = 1 THEN NULL ELSE (cents * 7) % 5000 END AS resp_bytes,
         cents % 13 AS orig_pkts, cents % 7 AS resp_pkts,
         CAST(CASE WHEN uid % 50 = 0 THEN 1 ELSE 0 END AS BIGINT) AS missed_bytes,
         label_raw, detailed_label, 'part' || CAST(uid % 3 AS VARCHAR) AS source_file,
         ((uid * 37) % 101) / CAST(100 AS DOUBLE) AS score
  FROM (
    SELECT event_id AS uid, ts AS event_time, user_id AS orig_h,
           CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS resp_p,
           CASE WHEN event_id % 10 <= 5 THEN 'tcp' WHEN event_id % 10 <= 8 THEN 'udp' ELSE 'icmp' END AS proto,
           CASE event_type WHEN 'error' THEN 'S0' WHEN 'click' THEN 'SF' WHEN 'view' THEN 'S1'
                           WHEN 'purchase' THEN 'RSTO' WHEN 'signup' THEN 'REJ' END AS conn_state,
           CASE event_id % 6 WHEN 0 THEN 'dns' WHEN 1 THEN 'http' WHEN 2 THEN NULL WHEN 3 THEN 'dns'
                             WHEN 4 THEN 'ssl' ELSE '-' END AS service,
           CAST(round(value * 100) AS BIGINT) AS cents,
           CASE event_type WHEN 'error' THEN 'Malicious   PartOfAHorizontalPortScan'
                           WHEN 'signup' THEN '  Malicious' ELSE 'Benign' END AS label_raw,
           CASE WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'C&C' END AS detailed_label
    FROM events) e
)"""

RAW = FLOWS + r""",
raw AS (
  SELECT uid, event_time, orig_h, resp_p, proto, conn_state, service,
         TRY_CAST(duration_raw AS DOUBLE) AS duration, CAST(orig_bytes AS DOUBLE) AS orig_bytes,
         CAST(resp_bytes AS DOUBLE) AS resp_bytes, CAST(orig_pkts AS DOUBLE) AS orig_pkts,
         CAST(resp_pkts AS DOUBLE) AS resp_pkts, missed_bytes, label_raw AS label, detailed_label,
         source_file
  FROM flows
)"""

LABELED = RAW + r""",
labeled0 AS (SELECT *, string_split_regex(trim(label), '\s{2,}') AS _parts FROM raw),
labeled1 AS (
  SELECT * EXCLUDE (label, detailed_label, _parts),
         CASE WHEN contains(trim(_parts[1]), 'Malicious') THEN 'Malicious' ELSE trim(_parts[1]) END AS label,
         CASE WHEN detailed_label IS NULL OR detailed_label = '' THEN _parts[2] ELSE detailed_label END
           AS detailed_label
  FROM labeled0),
labeled AS (
  SELECT * EXCLUDE (detailed_label),
         CASE WHEN detailed_label IS NULL AND label = 'Malicious' THEN 'unknown'
              WHEN detailed_label IS NULL AND label = 'Benign' THEN '' ELSE detailed_label END AS detailed_label
  FROM labeled1)"""

# D1 drops resp_bytes (25 % missing), D2 drops missed_bytes (98 % zeros);
# duration (exactly 20 % missing) stays because the rule is strict.
CLEAN = LABELED + r""",
imputed AS (
  SELECT * EXCLUDE (duration, orig_bytes, service),
         coalesce(duration, (SELECT median(duration) FROM labeled)) AS duration,
         coalesce(orig_bytes, (SELECT median(orig_bytes) FROM labeled)) AS orig_bytes,
         coalesce(service, (SELECT service FROM labeled WHERE service IS NOT NULL
                            GROUP BY service ORDER BY count(*) DESC, service LIMIT 1)) AS service
  FROM labeled),
clean AS (
  SELECT resp_p, proto, conn_state, service, duration, orig_bytes, orig_pkts, resp_pkts, label,
         detailed_label, source_file,
         CAST(hour(event_time) AS INTEGER) AS hour,
         CAST(isodow(event_time) - 1 AS INTEGER) AS day_of_week,
         CASE WHEN isodow(event_time) - 1 IN (5, 6) THEN 1 ELSE 0 END AS is_weekend,
         orig_pkts + resp_pkts AS total_pkts,
         ln(1 + orig_pkts + resp_pkts) AS log_total_pkts,
         orig_bytes / CASE WHEN orig_pkts = 0 THEN 1 ELSE orig_pkts END AS orig_bytes_per_pkt,
         orig_pkts / (resp_pkts + 1) AS pkts_ratio
  FROM imputed)"""

# fixed values: the dense lineitem view (a supplier is a source, a part a port)
LINEFLOWS = r"""
lineflows AS (
  SELECT l_orderkey AS uid, l_shipdate AS event_time, l_suppkey AS orig_h, l_partkey AS resp_p,
         CASE WHEN l_returnflag = 'R' THEN 'udp' ELSE 'tcp' END AS proto,
         l_returnflag || l_linestatus AS conn_state,
         l_quantity AS orig_pkts, l_extendedprice AS orig_bytes, l_tax AS resp_bytes,
         CASE WHEN l_returnflag = 'R' THEN 'Malicious' ELSE 'Benign' END AS label
  FROM lineitem)"""
