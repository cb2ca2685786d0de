"""DuckDB SQL with the same results as the queries, written without a look at how Spark does it."""

from __future__ import annotations

MONTH = "%-d %B %Y"

BM25 = """
toks AS (SELECT source AS corpus, doc_id AS doc, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM documents),
sized AS (SELECT corpus, doc, len(w) AS length FROM toks),
posts AS (SELECT corpus, term, doc, count(*) AS tf FROM (SELECT corpus, doc, unnest(w) AS term FROM toks) GROUP BY ALL),
corp AS (SELECT corpus, count(*) AS n_docs, avg(length) AS mean_length FROM sized GROUP BY corpus),
raws AS (SELECT corpus, term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw, mean_length FROM (SELECT corpus, term, count(*) AS df FROM posts GROUP BY ALL) JOIN corp USING (corpus)),
idfs AS (SELECT corpus, term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY corpus) ELSE raw END AS idf, mean_length FROM raws),
weights AS (SELECT corpus, term, doc, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / mean_length)) AS weight
  FROM posts JOIN idfs USING (corpus, term) JOIN sized USING (corpus, doc)),
qterms AS (SELECT query, term, count(*) AS qtf FROM (
  SELECT item_id AS query, unnest(list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query, corpus, doc, round(sum(qtf * weight), 9) AS score, count(*) AS matched FROM qterms JOIN weights USING (term) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, doc)::INTEGER AS rank FROM scored),
gold AS (SELECT item_id AS query, source AS corpus, doc_id AS doc FROM documents, benchmark WHERE contains(documents.text, benchmark.text))
"""

HITS = """
firsts AS (SELECT query, corpus, min(rank) FILTER (gold.doc IS NOT NULL) AS f FROM ranked LEFT JOIN gold USING (query, corpus, doc) GROUP BY query, corpus),
rows AS (SELECT query, corpus, (f <= 1)::INT AS hit1, (f <= 3)::INT AS hit3, (f <= 10)::INT AS hit10, 1.0 / f AS rr FROM firsts WHERE f IS NOT NULL)
"""

TRIGGER = """
base AS (SELECT doc_id, source, least(n_chars, 4000) AS n, toxic, quality AS label FROM documents JOIN labels USING (doc_id)),
trig AS (SELECT doc_id, label, n / (SELECT max(n) FROM base)::DOUBLE AS length, (1 - toxic)::DOUBLE AS clean, CASE WHEN source >= 'src5' THEN 'test' ELSE 'dev' END AS split FROM base),
trig2 AS (SELECT *, round(0.65 * length + 0.35 * clean, 9) AS blend FROM trig),
long AS (UNPIVOT (SELECT split, label, length, clean, blend FROM trig2) ON length, clean, blend INTO NAME model VALUE score),
per AS (SELECT split, model, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM long GROUP BY ALL),
swept AS (SELECT split, model, score, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY split, model) AS pos FROM per
  WINDOW w AS (PARTITION BY split, model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
rated AS (SELECT *, 2 * tp / (tp + fp + pos)::DOUBLE AS f1, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS prec, coalesce(tp / nullif(pos, 0)::DOUBLE, 0) AS rec FROM swept),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split, model ORDER BY f1 DESC, score) AS r FROM rated) WHERE r = 1)
"""

CITED = f"""
cited AS (SELECT o_orderkey, o_orderdate, o_custkey, n_name, c_name || ' v. ' || n_name AS name, left(o_orderpriority, 1) AS kind,
  o_orderkey::VARCHAR AS k, strftime(o_orderdate, '%y') AS yy, strftime(o_orderdate, '%Y') AS yyyy, strftime(o_orderdate, '{MONTH}') AS day
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
"""

APPEAR = """
appear AS (SELECT 'part:' || l_partkey AS case_key, l_orderkey * 100 + l_linenumber AS idx, p_name AS case_name, p_name || ', ' || p_brand AS citation, n_name AS guide_id,
  'Guide ' || n_name AS guide_title, strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS timestamp, l_partkey AS part
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
"""

MENTION = r"""
pieces AS (SELECT source, doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) - 1 AS pos FROM (SELECT source, doc_id,
  list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: len(x) >= 40) AS ps FROM documents)),
asked AS (SELECT 'src' || (item_id % 20) AS source, left(text, 12) AS citation FROM benchmark),
terms AS (SELECT source, citation, lower(trim(regexp_replace(citation, '\s+', ' ', 'g'))) AS t1,
  lower(trim(trim(regexp_replace(split_part(citation, ',', 1), '\s+', ' ', 'g')), '* ')) AS t2 FROM asked),
found AS (SELECT source, citation, doc_id, pos, p FROM pieces JOIN terms USING (source) WHERE contains(lower(p), t1) OR (t2 <> '' AND contains(lower(p), t2)))
"""

ORACLES: dict[str, str] = {
    "bm25_section_topk": f"WITH {BM25} SELECT query AS item_id, corpus AS source, doc AS doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 3",
    "retrieval_hit_mrr": f"""WITH {BM25}, {HITS}, sliced AS (
      SELECT unnest(list_filter(['all', CASE WHEN corpus = 'src0' THEN 'large_source' END, CASE WHEN corpus <> 'src0' THEN 'other_source' END, CASE WHEN query < 20 THEN 'first_half' END], lambda x: x IS NOT NULL)) AS slice, * FROM rows)
      SELECT s.slice, count(hit1) AS n, round(avg(hit1), 6) AS hit1, round(avg(hit3), 6) AS hit3, round(avg(hit10), 6) AS hit10, round(avg(rr), 6) AS rr
      FROM (VALUES ('all'), ('large_source'), ('other_source'), ('first_half')) s(slice) LEFT JOIN sliced USING (slice) GROUP BY s.slice""",
    "bm25_max_score": f"WITH {BM25} SELECT query AS item_id, corpus AS source, round(max(score), 6) AS score FROM scored GROUP BY query, corpus",
    "query_dedup_ablation": f"""WITH {BM25}, {HITS},
      once AS (SELECT query, corpus, doc, round(sum(weight), 9) AS score FROM qterms JOIN weights USING (term) GROUP BY ALL),
      ranked1 AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, doc) AS rank FROM once),
      firsts1 AS (SELECT query, corpus, min(rank) FILTER (gold.doc IS NOT NULL) AS f FROM ranked1 LEFT JOIN gold USING (query, corpus, doc) GROUP BY query, corpus),
      both_ AS (SELECT 'all_terms' AS variant, f FROM firsts WHERE f IS NOT NULL UNION ALL SELECT 'distinct_terms', f FROM firsts1 WHERE f IS NOT NULL)
      SELECT variant, count(*) AS n, round(avg((f <= 1)::INT), 6) AS hit1, round(avg((f <= 3)::INT), 6) AS hit3, round(avg((f <= 10)::INT), 6) AS hit10, round(avg(1.0 / f), 6) AS rr FROM both_ GROUP BY variant""",
    "two_stage_rank": f"""WITH {BM25}, g AS (SELECT query, corpus, row_number() OVER (PARTITION BY query ORDER BY best DESC, corpus)::INTEGER AS group_rank FROM (SELECT query, corpus, max(score) AS best FROM scored GROUP BY ALL)),
      r AS (SELECT query, corpus, doc, score, group_rank, row_number() OVER (PARTITION BY query ORDER BY group_rank, score DESC, doc)::INTEGER AS rank FROM scored JOIN g USING (query, corpus) WHERE group_rank <= 5)
      SELECT query AS item_id, corpus AS source, doc AS doc_id, round(score, 6) AS score, group_rank, rank FROM r WHERE rank <= 10""",
    "boosted_rank": f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY matched DESC, score DESC, doc)::INTEGER AS rank FROM scored)
      SELECT query AS item_id, corpus AS source, doc AS doc_id, round(score, 6) AS score, matched, rank FROM r WHERE rank <= 5""",
    "oracle_section_rank": f"""WITH {BM25} SELECT query AS item_id, corpus AS source, doc AS doc_id, round(score, 6) AS score, rank FROM ranked
      WHERE rank <= 5 AND (query, corpus) IN (SELECT query, corpus FROM gold)""",
    "random_rank": """SELECT source, doc_id, rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5(source || '|' || doc_id || '|42'), doc_id)::INTEGER AS rank FROM documents) WHERE rank <= 3""",
    "section_documents": """WITH g AS (SELECT conv_id, role, min(turn) AS first, string_agg(text, ' ' ORDER BY turn) AS body FROM conversations GROUP BY ALL)
      SELECT conv_id, role, (row_number() OVER (PARTITION BY conv_id ORDER BY first, role) - 1)::BIGINT AS idx, upper(role) AS title, md5(role || ' ' || upper(role) || ' ' || body) AS text_md5 FROM g""",
    "containing_documents": "SELECT item_id, source, doc_id FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text))",
    "trigger_auroc": f"""WITH {TRIGGER}, pairs AS (SELECT split, model, sum(n * (tp - p)) AS above, sum(n * p) AS tied, sum(p) AS pos, sum(n) AS neg FROM per JOIN swept USING (split, model, score) GROUP BY ALL)
      SELECT split, model, round((above + 0.5 * tied) / (pos * neg), 6) AS auroc, pos::BIGINT AS pos, neg::BIGINT AS neg, round((above + tied) / (pos * neg)::DOUBLE, 6) AS auroc_optimistic FROM pairs""",
    "trigger_best_f1": f"WITH {TRIGGER} SELECT split, model, round(score, 6) AS threshold, round(f1, 6) AS f1, round(prec, 6) AS precision, round(rec, 6) AS recall FROM best",
    "trigger_evaluation": f"""WITH {TRIGGER.replace("long AS (UNPIVOT (SELECT split,", "twice AS (SELECT * FROM trig2 UNION ALL SELECT * REPLACE ('all' AS split) FROM trig2), long AS (UNPIVOT (SELECT split,").replace("blend FROM trig2) ON", "blend FROM twice) ON")},
      pairs AS (SELECT split, model, sum(n * (tp - p)) + 0.5 * sum(n * p) AS area, sum(p) AS pos, sum(n) AS neg FROM per JOIN swept USING (split, model, score) GROUP BY ALL)
      SELECT split, model, round(area / (pairs.pos * neg), 6) AS auroc, round(f1, 6) AS f1, round(score, 6) AS threshold, 'oracle' AS threshold_source FROM pairs JOIN best USING (split, model)""",
    "trigger_fixed_thr": f"""WITH {TRIGGER}, c AS (SELECT split, model, count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label <> 1) AS fp,
      count(*) FILTER (score < 0.5 AND label = 1) AS fn, count(*) FILTER (score < 0.5 AND label <> 1) AS tn FROM long GROUP BY ALL)
      SELECT split, model, tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
      round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 6) AS accuracy FROM c""",
    "trigger_dev_threshold": f"""WITH {TRIGGER}, t AS (SELECT model, score AS threshold FROM best WHERE split = 'dev'),
      c AS (SELECT model, threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label <> 1) AS fp,
      count(*) FILTER (score < threshold AND label = 1) AS fn, count(*) FILTER (score < threshold AND label <> 1) AS tn FROM long JOIN t USING (model) WHERE split = 'test' GROUP BY ALL)
      SELECT model, round(threshold, 6) AS threshold, tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1 FROM c""",
    "random_scores": "SELECT doc_id, round(('0x' || left(md5(doc_id || '|42'), 12))::BIGINT / 281474976710656.0, 9)::DOUBLE AS score FROM labels",
    "length_stats": """WITH r AS (SELECT lang, round(length(text) / length(source)::DOUBLE, 3) AS ratio FROM documents)
      SELECT lang, count(*) AS n, round(avg(ratio), 6) AS mean, min(ratio) AS low, max(ratio) AS high, list_sort(list(ratio))[count(*) // 2 + 1] AS median FROM r GROUP BY lang""",
    "value_counts": "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL",
    "label_agreement": "SELECT source, round(avg((quality = toxic)::INT), 6) AS agreement, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "citation_parse": f"""WITH {CITED}, f AS (SELECT *, CASE WHEN kind = '1' THEN [] WHEN kind = '2' THEN [k || '/' || yy, k || '1/' || yy] WHEN kind = '3' THEN [] ELSE [k || '/' || yy] END AS apps FROM cited)
      SELECT o_orderkey, name AS case_name, array_to_string(apps, '|') AS application_numbers, yyyy AS judgment_year, contains(name, ' v. ') AS is_case,
      CASE WHEN len(apps) > 0 THEN 'apps:' || array_to_string(apps, '|') ELSE 'name:' || trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '[^a-z0-9/., -]+', ' ', 'g'), '[.,;:]+', ' ', 'g'), '\\s+', ' ', 'g')) || '::' || yyyy END AS case_key FROM f""",
    "suspicious_citations": f"""WITH {CITED}, full_ AS (SELECT CASE WHEN kind = '1' THEN name || ', ECHR ' || yyyy || '-I' WHEN kind = '2' THEN name || ', nos. ' || k || '/' || yy || ' and ' || k || '1/' || yy || ', ' || day
      WHEN kind = '3' THEN name || ', judgment of ' || day ELSE name || ', no. ' || k || '/' || yy || ', ' || day END AS c FROM cited),
      both_ AS (SELECT trim(c) AS c FROM full_ UNION ALL SELECT trim(substr(c, 20)) FROM full_),
      r AS (SELECT unnest(list_filter([CASE WHEN regexp_matches(c, '^[a-z]') THEN 'lowercase_start' END, CASE WHEN regexp_matches(c, '^v\\.') THEN 'starts_with_v' END, CASE WHEN regexp_matches(c, '[-–—]$') THEN 'hanging_dash' END,
      CASE WHEN regexp_matches(c, '\\b[A-Z]\\s+[a-z]{{3,}}\\b') THEN 'spacing_artifact' END, CASE WHEN NOT regexp_matches(c, '\\b\\d+/\\d+\\b') AND regexp_matches(c, '\\b(?:19|20)\\d{{2}}\\b') THEN 'no_app_number' END], lambda x: x IS NOT NULL)) AS reason FROM both_)
      SELECT reason, count(*) AS n FROM r GROUP BY reason""",
    "case_catalog": f"""WITH {APPEAR}, s AS (SELECT *, timestamp || '__' || guide_id AS pdf, timestamp || lpad(idx::VARCHAR, 15, '0') AS up, timestamp || lpad((999999999999 - idx)::VARCHAR, 15, '0') AS down FROM appear)
      SELECT case_key, arg_min(case_name, idx) AS case_name, arg_min(citation, idx) AS citation_example, count(DISTINCT citation) AS citation_variants, count(DISTINCT guide_id || timestamp) AS snapshots,
      array_to_string(list_sort(list(DISTINCT guide_id)), '|') AS guide_ids, array_to_string(list_sort(list(DISTINCT guide_title)), '|') AS guide_titles, min(timestamp) AS first_seen, arg_min(pdf, up) AS first_seen_pdf,
      max(timestamp) AS last_seen, arg_max(pdf, down) AS last_seen_pdf, count(DISTINCT guide_id) AS guides FROM s GROUP BY case_key""",
    "case_guides": f"WITH {APPEAR} SELECT case_key, guide_id, count(*) AS appearances, count(DISTINCT timestamp) AS snapshots, min(timestamp) AS first_seen, max(timestamp) AS last_seen FROM appear GROUP BY ALL",
    "snapshot_diff": f"""WITH {APPEAR}, l AS (SELECT DISTINCT guide_id, timestamp, part FROM appear), v AS (SELECT DISTINCT guide_id, timestamp FROM l),
      p AS (SELECT * FROM (SELECT guide_id, lag(timestamp) OVER (PARTITION BY guide_id ORDER BY timestamp) AS from_version, timestamp AS to_version FROM v) WHERE from_version IS NOT NULL),
      a AS (SELECT p.*, part FROM p JOIN l ON l.guide_id = p.guide_id AND l.timestamp = from_version), b AS (SELECT p.*, part FROM p JOIN l ON l.guide_id = p.guide_id AND l.timestamp = to_version),
      c AS (SELECT 'added' AS change, * FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'removed', * FROM (SELECT * FROM a EXCEPT SELECT * FROM b))
      SELECT guide_id, from_version, to_version, change, count(*) AS n, min(part) AS least, max(part) AS most, sum(part)::BIGINT AS total FROM c GROUP BY ALL""",
    "sticky_baseline": """WITH l AS (SELECT n_name AS guide_id, strftime(date_trunc('quarter', l_shipdate), '%Y%m%d') AS timestamp, array_to_string(list_sort(list(DISTINCT l_suppkey)), ',') AS content
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
      c AS (SELECT guide_id, timestamp FROM (SELECT *, lag(content) OVER (PARTITION BY guide_id ORDER BY timestamp) AS b FROM l) WHERE b IS NULL OR b <> content)
      SELECT * FROM (SELECT guide_id, lag(timestamp) OVER (PARTITION BY guide_id ORDER BY timestamp) AS from_version, timestamp AS to_version FROM c) WHERE from_version IS NOT NULL""",
    "keyed_rows": """SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderpriority, o_orderkey) AS o_orderpriority, max(o_orderkey) AS last_order, arg_max(o_orderpriority, o_orderkey) AS last_priority FROM orders GROUP BY o_custkey""",
    "link_theta_join": """SELECT item_id, source, doc_id, CASE WHEN contains(documents.text, benchmark.text) THEN 'paragraph_text_exact|' ELSE '' END || 'paragraph_text_folded' AS strategies,
      row_number() OVER (PARTITION BY item_id ORDER BY source, doc_id)::INTEGER AS paragraph_rank FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text))""",
    "strategy_counts": """WITH m AS (SELECT contains(documents.text, benchmark.text) AS e FROM documents, benchmark WHERE contains(lower(documents.text), lower(benchmark.text)))
      SELECT 'paragraph_text_folded' AS strategy, count(*) AS n FROM m UNION ALL SELECT 'paragraph_text_exact', count(*) FROM m WHERE e HAVING count(*) > 0""",
    "usable_flags": """WITH r AS (SELECT doc_id, quality IS NOT NULL AS relevant, n_chars > 500 AS located, lang <> 'de' AS typed, coalesce(quality = 1, false) AS added, trim(text) <> '' AS filled, coalesce(toxic = 1, false) AS strict, lang = 'en' AS en, n_chars
      FROM documents LEFT JOIN labels USING (doc_id))
      SELECT doc_id, relevant AS usable_for_relevance, relevant AND located AS usable_for_location, relevant AND located AND typed AS usable_for_edit_type, relevant AND located AND added AND filled AS usable_for_generation,
      strict AS strict_citation_field_match, en AS case_text_available, CASE WHEN en THEN 'texts/' || doc_id END AS case_text_path, CASE WHEN en THEN n_chars END AS case_text_chars FROM r""",
    "edit_type": """WITH o AS (SELECT o_orderkey, o_orderstatus = 'P' AS removed, CASE o_orderpriority WHEN '1-URGENT' THEN 'section_modified' WHEN '2-HIGH' THEN 'section_removed' ELSE 'paragraph_added' END AS t,
        length(o_orderpriority) AS pre, o_custkey % 17 AS post FROM orders),
      g AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, count(*) FILTER (f = 'RF') AS rf, count(*) FILTER (f = 'RO') AS ro, count(*) FILTER (f = 'AF') AS af, count(*) FILTER (f = 'AO') AS ao, count(*) FILTER (f = 'NF') AS nf, count(*) FILTER (f = 'NO') AS no_,
        count(*) FILTER (f = 'AO' AND l_quantity <= 25) AS ao_empty, min(1 - l_discount * 2) AS low FROM (SELECT *, l_returnflag || l_linestatus AS f FROM lineitem) GROUP BY ALL),
      x AS (SELECT o.*, g.* EXCLUDE (o_orderkey), CASE WHEN removed THEN 'remove_citation' WHEN t = 'paragraph_added' THEN 'add_citation' WHEN t = 'section_modified' THEN CASE WHEN post = 0 OR post / pre > 1.5 THEN 'add_citation' ELSE 'revise_text' END
        ELSE 'remove_citation' END AS legacy, ro > 0 AS deep, ro + af + no_ > 0 AS rev, rf > 0 AS rem, nf + ao > 0 AS addn, ao > 0 AND ao_empty = ao AS fresh FROM o LEFT JOIN g USING (o_orderkey)),
      y AS (SELECT *, CASE WHEN removed THEN 1 WHEN n IS NULL THEN 2 WHEN rem AND NOT addn AND NOT rev THEN 3 WHEN rev AND fresh AND low >= 0.85 THEN 4 WHEN rev THEN 5 WHEN fresh THEN 6 WHEN nf > 0 THEN 7 WHEN addn THEN 8 ELSE 2 END AS c FROM x)
      SELECT o_orderkey, legacy AS legacy_edit_type, CASE WHEN c IN (1, 3) THEN 'remove_citation' WHEN c = 2 THEN legacy WHEN c = 5 THEN 'revise_text' ELSE 'add_citation' END AS edit_type,
      CASE c WHEN 1 THEN 'citation_remove' WHEN 2 THEN 'legacy_fallback' WHEN 3 THEN 'citation_remove' WHEN 4 THEN 'new_paragraph' WHEN 6 THEN 'new_paragraph' WHEN 7 THEN 'citation_insert' WHEN 8 THEN 'paragraph_extension'
        ELSE CASE WHEN af > 0 AND NOT deep THEN 'citation_refresh' WHEN no_ > 0 AND NOT deep AND af = 0 THEN 'paragraph_rewrite' ELSE 'doctrinal_rewrite' END END AS subtype,
      CASE WHEN c IN (1, 3, 6) THEN 'high' WHEN c = 2 THEN 'low' WHEN c IN (4, 8) THEN 'medium' WHEN c = 5 THEN CASE WHEN deep OR low < 0.85 THEN 'high' ELSE 'medium' END ELSE CASE WHEN low >= 0.95 THEN 'high' ELSE 'medium' END END AS confidence FROM y""",
    "pipeline_cascade": f"""WITH {TRIGGER}, thr AS (SELECT score AS t FROM best WHERE split = 'dev' AND model = 'blend'),
      r AS (SELECT split, label = 1 AS pos, blend >= t AS hit, (lang = 'en')::INT AS h FROM trig2 JOIN documents USING (doc_id), thr),
      c AS (SELECT split, count(*) AS n, count(*) FILTER (hit AND pos) AS tp, count(*) FILTER (hit AND NOT pos) AS fp, count(*) FILTER (NOT hit AND pos) AS fn, sum(h) FILTER (hit AND pos) AS loc, sum(h) FILTER (pos) AS loc_all FROM r GROUP BY split)
      SELECT split, n, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 4) AS precision, round(tp / (tp + fn)::DOUBLE, 4) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 4) AS f1,
      round(loc / tp::DOUBLE, 4) AS location_given_trigger, round(loc_all / (tp + fn)::DOUBLE, 4) AS location_all, round(loc / (tp + fn)::DOUBLE, 4) AS pipeline_hit1 FROM c""",
    "negatives_topk": """WITH c AS (SELECT o_orderkey AS item, o_orderdate AS d, o_custkey AS cust, n_name, date_trunc('month', o_orderdate)::DATE AS m FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
      newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY d DESC, item) AS r FROM c) WHERE r <= 200),
      tr AS (SELECT DISTINCT n_name || '|' || m AS id, n_name, m FROM c),
      free AS (SELECT id, item, d FROM tr JOIN newest USING (m) WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_name = tr.n_name AND c.m = tr.m AND c.cust = newest.cust))
      SELECT id, item, rank FROM (SELECT id, item, row_number() OVER (PARTITION BY id ORDER BY d DESC, item)::INTEGER AS rank FROM free) WHERE rank <= 30""",
    "window_join": """WITH w AS (SELECT DISTINCT ts::DATE AS d FROM events WHERE event_type = 'error' AND value > 40)
      SELECT d::VARCHAR AS from_date, count(*) AS n, min(event_id) AS least FROM w JOIN events ON ts >= d AND ts < d + INTERVAL 3 DAY GROUP BY d""",
    "round_robin_sample": """WITH t AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5(doc_id || '|42'), doc_id) AS turn FROM documents)
      SELECT doc_id, lang, source, turn FROM t ORDER BY turn, md5(lang || '|' || source || '|42'), lang || '|' || source LIMIT 100""",
    "stratified_sample": """WITH d AS (SELECT doc_id, lang, n_chars, md5(doc_id || '|42') AS h FROM documents), head AS (SELECT * FROM d WHERE n_chars > 4000 ORDER BY h, doc_id LIMIT 10),
      rest AS (SELECT * FROM d WHERE doc_id NOT IN (SELECT doc_id FROM head)),
      b AS (SELECT lang, greatest(5, round(60 * count(*) / (SELECT count(*) FROM rest)::DOUBLE)) AS budget FROM rest GROUP BY lang),
      n AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r FROM rest)
      SELECT doc_id, lang FROM (SELECT doc_id, lang, h, 0 AS part FROM head UNION ALL SELECT doc_id, n.lang, h, 1 FROM n JOIN b USING (lang) WHERE r <= budget) ORDER BY part, h, doc_id LIMIT 60""",
    "section_events": r"""WITH t AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\s+')) AS w FROM conversations), s AS (SELECT conv_id, turn, lower(w) AS path, min(w) AS title, count(*)::INTEGER AS level FROM t WHERE w <> '' GROUP BY ALL),
      k AS (SELECT DISTINCT conv_id, turn FROM conversations),
      a AS (SELECT s.* FROM s WHERE (conv_id, turn + 1) IN (SELECT conv_id, turn FROM k)), b AS (SELECT s.* REPLACE (turn - 1 AS turn) FROM s WHERE (conv_id, turn - 1) IN (SELECT conv_id, turn FROM k)),
      j AS (SELECT conv_id, turn, path, a.title AS ta, b.title AS tb, coalesce(a.level, b.level) AS level FROM a FULL JOIN b USING (conv_id, turn, path))
      SELECT conv_id, turn, CASE WHEN tb IS NULL THEN 'section_deleted' WHEN ta IS NULL THEN 'section_added' ELSE 'section_title_changed' END AS change_type, path, CASE WHEN ta IS NULL OR tb IS NULL THEN coalesce(ta, tb) END AS title, level,
      CASE WHEN tb IS NOT NULL AND ta IS NOT NULL THEN ta END AS title_a, CASE WHEN tb IS NOT NULL AND ta IS NOT NULL THEN tb END AS title_b FROM j WHERE ta IS NULL OR tb IS NULL OR ta <> tb""",
    "unique_text_align": r"""WITH t AS (SELECT conv_id, turn, unnest(ws) AS w, generate_subscripts(ws, 1)::INTEGER - 1 AS pos FROM (SELECT conv_id, turn, string_split_regex(text, '\s+') AS ws FROM conversations)),
      u AS (SELECT conv_id, turn, lower(w) AS w, min(pos) AS pos FROM t WHERE w <> '' GROUP BY ALL HAVING count(*) = 1)
      SELECT a.conv_id, a.turn, a.pos AS a_order, b.pos AS b_order FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.turn + 2 = b.turn AND a.w = b.w""",
    "asof_section": """WITH a AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'signup'), f AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS first FROM a GROUP BY user_id)
      SELECT e.event_id, coalesce((SELECT arg_max(a.event_id, (a.ts, a.event_id)) FROM a WHERE a.user_id = e.user_id AND (a.ts < e.ts OR (a.ts = e.ts AND a.event_id <= e.event_id))), f.first) AS section
      FROM events e LEFT JOIN f USING (user_id) WHERE e.event_type <> 'signup'""",
    "law_section_split": r"""WITH m AS (SELECT doc_id, lang, source, text, CASE WHEN lang <> 'fr' THEN 'THE FACTS' ELSE 'FACTS' END AS head, CASE WHEN lang <> 'es' THEN 'FOR THESE REASONS, THE COURT' ELSE 'END' END AS stop FROM documents),
      x AS (SELECT *, string_split(concat_ws(chr(10), head, text, 'The Law', source, text, stop, lang), chr(10)) AS ls FROM m)
      SELECT doc_id, md5(CASE WHEN lang = 'fr' THEN '' ELSE concat_ws(chr(10), head, text) END) AS facts, md5(CASE WHEN lang = 'fr' THEN '' WHEN lang = 'es' THEN concat_ws(chr(10), 'The Law', source, text, stop, lang) ELSE concat_ws(chr(10), 'The Law', source, text) END) AS law,
      md5(CASE WHEN lang IN ('fr', 'es') THEN '' ELSE concat_ws(chr(10), stop, lang) END) AS operative, md5(array_to_string(ls[1:len(ls) // 2], chr(10))) AS first_half FROM x""",
    "json_props": "SELECT event_type, 'k' AS key, count(*) AS n, sum((props->>'k')::INT)::BIGINT AS total FROM events GROUP BY event_type",
    "html_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
      b AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM a)
      SELECT page_id, md5(t) AS text_md5, length(t) AS n_chars FROM b""",
    "dataset_reaudit": """WITH r AS (SELECT source, list(doc_id::VARCHAR) AS a, list(DISTINCT lang) AS l FROM documents WHERE lang <> 'de' GROUP BY source), o AS (SELECT source, list(doc_id::VARCHAR) AS a, list(DISTINCT lang) AS l FROM documents WHERE lang <> 'fr' AND source <> 'src3' GROUP BY source),
      j AS (SELECT source, r.a IS NULL AS no_ref, o.a IS NULL AS no_loc, coalesce(r.a, []) AS ra, coalesce(o.a, []) AS oa, coalesce(r.l, []) AS rl, coalesce(o.l, []) AS ol FROM r FULL JOIN o USING (source)),
      d AS (SELECT *, list_sort(list_filter(ra, lambda x: NOT list_contains(oa, x))) AS a1, list_sort(list_filter(oa, lambda x: NOT list_contains(ra, x))) AS a2, list_sort(list_filter(rl, lambda x: NOT list_contains(ol, x))) AS r1, list_sort(list_filter(ol, lambda x: NOT list_contains(rl, x))) AS r2 FROM j)
      SELECT source, CASE WHEN no_loc THEN 'reference_only' WHEN no_ref THEN 'local_only' WHEN len(a1) + len(a2) + len(r1) + len(r2) = 0 THEN 'exact' ELSE 'changed' END AS state, array_to_string(a1, '|') AS added_only_reference, array_to_string(a2, '|') AS added_only_local,
      array_to_string(r1, '|') AS removed_only_reference, array_to_string(r2, '|') AS removed_only_local FROM d""",
    "mentions": f"WITH {MENTION} SELECT source, citation, doc_id, pos::BIGINT AS pos, md5(p) AS paragraph_md5 FROM found",
    "mention_summary": f"""WITH {MENTION}, g AS (SELECT source, citation, count(*) AS n, list(doc_id ORDER BY doc_id, pos) AS ps FROM found GROUP BY ALL)
      SELECT source AS doc, citation, n, n || ' body mention(s) found on page(s): ' || array_to_string(ps[1:5], ', ') || CASE WHEN n > 5 THEN ', ...' ELSE '' END AS summary FROM g""",
}
ORACLES["edit_type_counts"] = f"""WITH e AS ({ORACLES['edit_type']}) SELECT edit_type, subtype, count(*) AS n, round(avg((edit_type = legacy_edit_type)::INT), 6) AS agreement FROM e GROUP BY ALL"""
ORACLES |= {
    "query_builders": """WITH c AS (SELECT c_custkey, lower(regexp_replace(c_name, '[^A-Za-z0-9]+', ' ', 'g')) AS name, c_custkey || ' ' || c_nationkey || ' ' || c_nationkey || ' 01' AS apps, lower(c_mktsegment) AS said FROM customer)
      SELECT c_custkey, name || ' ' || apps || ' ' || said AS apps_first, name || ' ' || said || ' ' || apps AS citation_first, name || ' ' || apps AS base FROM c""",
    "subtype_means": """WITH r AS (SELECT CASE WHEN source >= 'src5' THEN 'test' ELSE 'dev' END AS split, CASE WHEN toxic IS NULL THEN 'unknown' WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END AS subtype, quality, n_chars
      FROM documents LEFT JOIN labels USING (doc_id) WHERE lang = 'en' AND text <> '')
      SELECT split, subtype, count(*) AS n, coalesce(round(avg(quality), 4), 0) AS quality, coalesce(round(avg(n_chars), 4), 0) AS n_chars FROM r GROUP BY ALL""",
    "base_rates": """SELECT source, count(*) AS n, round(avg(coalesce(lang = 'en', false)::INT), 6) AS base_rate, sum(len(string_split(text, ' ')) + 1)::BIGINT AS elements FROM documents GROUP BY source""",
    "gold_in_corpus": """SELECT c_nationkey, count(*) AS n, round(avg((EXISTS (SELECT 1 FROM customer b WHERE b.c_acctbal > 9000 AND b.c_nationkey = a.c_nationkey AND b.c_mktsegment = a.c_mktsegment))::INT), 4) AS rate FROM customer a GROUP BY c_nationkey""",
    "carried_rows": """SELECT doc_id::VARCHAR AS doc_id, coalesce(lang, '') AS lang, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic, '' AS importance FROM documents LEFT JOIN labels USING (doc_id)""",
    "segment_menu": """SELECT c_mktsegment, max(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment""",
}
