"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

DECONTAMINATION = r"""
WITH d AS (
  SELECT doc_id, coalesce(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> ''), []) AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws
  FROM benchmark
), w AS (
  SELECT DISTINCT item, array_to_string(ws[i : least(i + 12, len(ws))], ' ') AS wt, least(13, len(ws)) AS n
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT n FROM w),
g AS (
  SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS wt
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)
), h AS (SELECT g.doc_id, g.i, w.n, w.item FROM g JOIN w ON g.wt = w.wt AND g.n = w.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def mixing_sql(topics: dict[str, float], rounds: int = 40, temper: float = 0.7, budget: float = 0.5) -> str:
    """The raking, unrolled far enough to have met the targets; topics: their target shares."""
    margins = ("source", "lang", "topic")
    out = [
        r"""WITH r AS (
  SELECT doc_id, text, source, lang, coalesce(source, chr(0)) AS cs, coalesce(lang, chr(0)) AS cg,
    CASE WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), 'http://') OR contains(coalesce(text, ''), 'https://') THEN 'links' WHEN contains(coalesce(text, ''), ' | ') THEN 'table'
      WHEN contains(coalesce(text, ''), '!!') THEN 'shouting' WHEN contains(coalesce(text, ''), chr(10)) THEN 'article' ELSE 'note' END AS topic,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\x0B\f\r]+')) AS BIGINT) AS n_tokens
  FROM documents
), w0 AS (SELECT cs, cg, topic AS ct, sum(n_tokens)::DOUBLE AS mass FROM r GROUP BY ALL)"""
    ]
    cols = {"source": "cs", "lang": "cg", "topic": "ct"}
    for m in margins:
        c = cols[m]
        share = "sum(mass) / (SELECT sum(mass) FROM w0)"
        aim = f"pow({share}, {temper})" if m != "topic" else "CASE ct " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in topics.items()) + f" ELSE {share} END"
        out.append(f"raw_{c} AS (SELECT {c}, {aim} AS a, max(mass) AS top FROM w0 GROUP BY {c}), aim_{c} AS (SELECT {c}, a / (SELECT sum(a) FROM raw_{c} WHERE top > 0) AS aim FROM raw_{c})")
    out.append("s0 AS (SELECT w0.*, aim_cs.aim AS x_cs, aim_cg.aim AS x_cg, aim_ct.aim AS x_ct, mass / (SELECT sum(mass) FROM w0) AS weight FROM w0 JOIN aim_cs USING (cs) JOIN aim_cg USING (cg) JOIN aim_ct USING (ct))")
    k = 0
    for _ in range(rounds):
        for m in margins:
            c = cols[m]
            out.append(f"s{k + 1} AS MATERIALIZED (SELECT cs, cg, ct, mass, x_cs, x_cg, x_ct, CASE WHEN sum(weight) OVER (PARTITION BY {c}) > 0 THEN weight * x_{c} / sum(weight) OVER (PARTITION BY {c}) ELSE 0 END AS weight FROM s{k})")
            k += 1
    out.append(f"""p AS (SELECT *, CASE WHEN mass > 0 THEN weight / mass ELSE 0 END AS ratio FROM s{k}),
q AS (SELECT *, (sum(mass) OVER () * {budget} - coalesce(sum(mass) OVER (ORDER BY ratio DESC, cs, cg, ct ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio DESC, cs, cg, ct ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM p),
f AS (SELECT c FROM q WHERE ratio > 0 AND c * ratio <= 1 + 1e-12 ORDER BY ratio DESC, c DESC LIMIT 1),
z AS (SELECT cs, cg, ct, mass, weight, CASE WHEN mass <= 0 THEN 1.0 ELSE least(1.0, coalesce((SELECT c FROM f) * ratio, 1.0)) END AS prob FROM q)
SELECT doc_id, source, lang, r.topic AS topic, n_tokens, round(CASE WHEN z.mass > 0 THEN z.weight * n_tokens / z.mass ELSE 0 END, 12) AS weight, round(prob, 9) AS prob,
  CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || coalesce(r.text, ''))), 1, 7)) AS BIGINT) / 268435456.0 < prob AS kept
FROM r JOIN z ON r.cs = z.cs AND r.cg = z.cg AND r.topic = z.ct""")
    return ",\n".join(out)
