"""The same results in plain SQL, written independently of the operators."""

from __future__ import annotations

from .inputs import SUBWORDS

_VIEWS = {
    "html_features": """SELECT cast(d.doc_id AS varchar) visit_id,
        concat('site', cast(d.doc_id AS varchar), '.', d.lang) domain_name, d.text body_text,
        coalesce(d.source, '') meta_text, d.n_chars nb_letters FROM documents d""",
    "visits_quality": """SELECT cast(doc_id AS varchar) visit_id,
        CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END label FROM labels""",
    "visits_toxic": """SELECT cast(doc_id AS varchar) visit_id,
        CASE WHEN toxic = 1 THEN 'Toxic' ELSE 'Clean' END label FROM labels""",
    "votes": """SELECT concat(cast(user_id AS varchar), '-', cast(cast(ts AS date) AS varchar)) visit_id,
        row_number() OVER (PARTITION BY user_id, cast(ts AS date) ORDER BY ts, event_id) vote_ord,
        event_type label, value FROM events""",
    "pred1": """SELECT visit_id, label predicted_label FROM (SELECT *, row_number() OVER
        (PARTITION BY visit_id ORDER BY value DESC, vote_ord) r FROM votes) t WHERE r = 1""",
    "pred2": """SELECT visit_id, label predicted_label FROM (SELECT *, row_number() OVER
        (PARTITION BY visit_id ORDER BY value, vote_ord) r FROM votes) t WHERE r = 1""",
    "pred3": """SELECT visit_id, label predicted_label FROM (SELECT *, row_number() OVER
        (PARTITION BY visit_id ORDER BY vote_ord DESC) r FROM votes) t WHERE r = 1""",
    "votes_binary": """SELECT visit_id, vote_ord,
        CASE WHEN label IN ('purchase', 'signup') THEN 1 ELSE 0 END y FROM votes""",
    "scores": "SELECT visit_id, max(value) / (1 + max(value)) prediction FROM votes GROUP BY visit_id",
    "low_scores": "SELECT visit_id, min(value) / (1 + min(value)) prediction FROM votes GROUP BY visit_id",
    # votes per page and label, and the summary of each page
    "tallied": "SELECT visit_id, label, count(*) n, min(vote_ord) f FROM votes GROUP BY 1, 2",
    "ranked": """SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY n DESC, f) r FROM tallied""",
    "judged": """SELECT a.visit_id, a.label top_label, a.n top_votes, s.n_votes, s.n_labels,
        (b.n IS NULL OR a.n > b.n) has_majority, s.n_labels = 1 unanimous
        FROM ranked a
        JOIN (SELECT visit_id, sum(n) n_votes, count(*) n_labels FROM tallied GROUP BY 1) s USING (visit_id)
        LEFT JOIN ranked b ON b.visit_id = a.visit_id AND b.r = 2 WHERE a.r = 1""",
    "bpages": """SELECT visit_id, count(*) n, sum(y) pos FROM votes_binary GROUP BY 1""",
    "bjudged": """SELECT *, (pos = 0 OR pos = n) unanimous, 2 * pos > n positive FROM bpages WHERE 2 * pos <> n""",
}


def _with(sql: str, *views: str) -> str:
    """`sql` behind the needed views; they are listed in dependency order."""
    return "WITH " + ", ".join(f"{v} AS ({_VIEWS[v]})" for v in views) + "\n" + sql


_JUDGED = ("votes", "tallied", "ranked", "judged")


def _multiclass(preds: str, value: str) -> str:
    """Rows (population, metric, label, <value>) of one prediction view, as a subquery."""
    return f"""(
      WITH base AS (SELECT j.*, p.predicted_label FROM judged j JOIN {preds} p USING (visit_id)),
      pop AS (SELECT 'all' population, * FROM base WHERE has_majority
              UNION ALL SELECT 'unanimous', * FROM base WHERE has_majority AND unanimous
              UNION ALL SELECT 'controversial', * FROM base WHERE has_majority AND NOT unanimous),
      per AS (SELECT q.population, u.label,
                count(*) FILTER (WHERE x.top_label = u.label AND x.predicted_label = u.label) tp,
                count(*) FILTER (WHERE x.top_label <> u.label AND x.predicted_label = u.label) fp,
                count(*) FILTER (WHERE x.top_label = u.label AND x.predicted_label <> u.label) fn
              FROM (SELECT unnest(['all', 'unanimous', 'controversial']) population) q
              CROSS JOIN universe u LEFT JOIN pop x ON x.population = q.population GROUP BY 1, 2),
      f AS (SELECT *, CASE WHEN 2*tp+fp+fn = 0 THEN 0.0::double ELSE 2.0::double*tp/(2*tp+fp+fn) END f1 FROM per),
      inc AS (SELECT 'all' population, avg(CASE WHEN t.label IS NULL THEN 0.0 ELSE 1.0 END) v
              FROM base b LEFT JOIN tallied t ON t.visit_id = b.visit_id AND t.label = b.predicted_label
              UNION ALL
              SELECT 'controversial', avg(CASE WHEN t.label IS NULL THEN 0.0 ELSE 1.0 END)
              FROM base b LEFT JOIN tallied t ON t.visit_id = b.visit_id AND t.label = b.predicted_label
              WHERE NOT b.unanimous)
      SELECT population, 'f1' metric, label, f1 {value} FROM f
      UNION ALL SELECT population, 'macro_f1', '', avg(f1) FROM f GROUP BY population
      UNION ALL SELECT population, 'weighted_f1', '', sum(f1*(tp+fn))/sum(tp+fn) FROM f GROUP BY population
      UNION ALL SELECT population, 'accuracy', '', sum(tp)::double/sum(tp+fn) FROM f GROUP BY population
      UNION ALL SELECT population, 'included', '', v FROM inc)"""


_UNIVERSE1 = "universe AS (SELECT label FROM votes UNION SELECT predicted_label FROM pred1)"
_UNIVERSE2 = _UNIVERSE1[:-1] + " UNION SELECT predicted_label FROM pred2)"

_MULTI = (
    _with("", *_JUDGED, "pred1").rstrip() + f", {_UNIVERSE1}\n"
    f"SELECT population, metric, label, round(value, 6) AS value FROM {_multiclass('pred1', 'value')} m"
)


# the same views over the stored three-vote lists
_LISTED = """WITH votes AS (SELECT cast(doc_id AS varchar) visit_id, unnest([1, 2, 3]) vote_ord, unnest([
    CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END, CASE WHEN toxic = 0 THEN 'Good' ELSE 'Poor' END,
    CASE WHEN doc_id % 3 = 0 THEN 'Skip' WHEN doc_id % 5 > 0 THEN 'Good' ELSE 'Poor' END]) label FROM labels),
  pred1 AS (SELECT cast(doc_id AS varchar) visit_id, CASE WHEN doc_id % 4 = 0 THEN 'Poor'
    WHEN doc_id % 4 = 1 THEN 'Skip' ELSE 'Good' END predicted_label FROM labels), """ + ", ".join(
    f"{v} AS ({_VIEWS[v]})" for v in ("tallied", "ranked", "judged")
)


def _binary(scores: str, value: str) -> str:
    parts = []
    for population, member in (("all", "true"), ("unanimous", "unanimous"), ("controversial", "NOT unanimous")):
        parts.append(f"""SELECT '{population}' population,
            count(*) FILTER (WHERE s.prediction > 0.98 AND positive)::double tp,
            count(*) FILTER (WHERE s.prediction > 0.98 AND NOT positive)::double fp,
            count(*) FILTER (WHERE NOT s.prediction > 0.98 AND positive)::double fn
            FROM bjudged JOIN {scores} s USING (visit_id) WHERE {member}""")
    cells = " UNION ALL ".join(parts)
    nan = "CASE WHEN tp+fp = 0 THEN 'nan'::double ELSE {} END"
    return f"""(WITH cells AS ({cells})
        SELECT population, 'precision' metric, {nan.format('tp/nullif(tp+fp,0)')} {value} FROM cells
        UNION ALL SELECT population, 'recall', {nan.format('tp/nullif(tp+fn,0)')} FROM cells
        UNION ALL SELECT population, 'f1', {nan.format('2*tp/nullif(2*tp+fp+fn,0)')} FROM cells)"""


_BINARY = ("votes", "votes_binary", "scores", "bpages", "bjudged")

_CURVE = _with("", *_BINARY).rstrip() + """,
scored AS (SELECT s.prediction score, CASE WHEN positive THEN 1 ELSE 0 END y FROM bjudged JOIN scores s USING (visit_id)),
grouped AS (SELECT score, sum(y) pos, count(*) n FROM scored GROUP BY 1),
summed AS (SELECT score, sum(pos) OVER w tp, sum(n) OVER w seen, sum(pos) OVER () total FROM grouped
           WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
curve AS (SELECT score threshold, tp::double/seen "precision", tp::double/total recall FROM summed
          UNION ALL SELECT NULL, 1.0, 0.0)
"""

_CONFUSION = _with("", *_JUDGED, "pred1").rstrip() + """,
pairs AS (SELECT top_label t, predicted_label p, count(*) n FROM judged JOIN pred1 USING (visit_id) GROUP BY 1, 2),
totals AS (SELECT t, row_number() OVER (ORDER BY sum(n) DESC, t) true_rank FROM pairs GROUP BY t),
cells AS (SELECT a.t true_label, a.true_rank, b.t predicted_label, coalesce(pairs.n, 0) n
          FROM totals a CROSS JOIN totals b LEFT JOIN pairs ON pairs.t = a.t AND pairs.p = b.t),
shares AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY true_label) = 0 THEN 0.0
           ELSE 100.0::double * n / sum(n) OVER (PARTITION BY true_label) END share FROM cells)
"""

# k = 3: the majority label of three ballots, or the first one
_BALLOTS = _with("", "votes", "pred1", "pred2", "pred3").rstrip() + """,
ballots AS (SELECT pred1.visit_id, pred1.predicted_label a, pred2.predicted_label b, pred3.predicted_label c
            FROM pred1 JOIN pred2 USING (visit_id) JOIN pred3 USING (visit_id))
"""

_SOFTMAX = """WITH l AS (SELECT vec_id, [x::double for x in embedding] v FROM embeddings),
e AS (SELECT vec_id, [exp(x - list_max(v)) for x in v] v FROM l),
p AS (SELECT vec_id, [x / list_sum(v) for x in v] v FROM e)
"""

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"

_VOCABULARY = f"""WITH toks AS (SELECT doc_id, {_WORDS} w FROM documents),
flat AS (SELECT doc_id, unnest(w) token, generate_subscripts(w, 1) pos, len(w) n FROM toks),
counted AS (SELECT token, count(*) n FROM flat GROUP BY token),
vocab AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 token_id
          FROM counted)
"""

# Every distinct word is merged step by step: of its pairs of pieces the one of least rank, the first of equal ones.
_SUBWORDS = r"""WITH RECURSIVE ranks AS (
  SELECT rank + 4 id, hex(from_base64(piece64)) piece FROM read_csv('""" + SUBWORDS + r"""', delim = ' ', quote = '', escape = '',
    header = false, columns = {'piece64': 'VARCHAR', 'rank': 'BIGINT'})),
cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''),
  ' ?\p{L}+| ?\p{N}+| ?[^ \t\n\x0B\f\r\p{L}\p{N}]+|[ \t\n\x0B\f\r]+') w FROM documents),
placed AS (SELECT doc_id, unnest(w) word, generate_subscripts(w, 1) pos FROM cut),
merging AS (
  SELECT word, regexp_extract_all(hex(encode(word)), '..') parts FROM (SELECT DISTINCT word FROM placed)
  UNION ALL
  SELECT word, list_concat(list_concat(list_slice(parts, 1, i - 1), [parts[i] || parts[i + 1]]), list_slice(parts, i + 2, len(parts)))
  FROM (
    SELECT word, any_value(parts) parts, arg_min(i, {'rank': r.id, 'i': i}) i FROM (
      SELECT word, parts, i, parts[i] || parts[i + 1] piece
      FROM (SELECT word, parts, unnest(range(1, len(parts))) i FROM merging) x) p
    JOIN ranks r USING (piece) GROUP BY word) q),
spelled AS (SELECT word, arg_min(parts, len(parts)) parts FROM merging GROUP BY word)
"""

# Windows and their sums, from `toks` (doc_id, w) and `ids` (doc_id, pos, n, id).
_WINDOW_SUMS = """sizes AS (SELECT doc_id, len(w) n FROM toks),
        wins AS (SELECT doc_id, n, 0 window_no, 0 skip FROM sizes
                 UNION ALL SELECT doc_id, n, 1, n - 510 FROM sizes WHERE n > 510),
        body AS (SELECT w.doc_id, w.window_no, i.id, i.pos - w.skip + 1 place
                 FROM wins w JOIN ids i ON i.doc_id = w.doc_id AND i.pos - w.skip BETWEEN 1 AND 510),
        summed AS (SELECT doc_id, window_no, sum(id * place) s, max(CASE WHEN place = 2 THEN id END) second_id
                   FROM body GROUP BY 1, 2),
        ends AS (SELECT *, least(n, 510) + 2 n_visible FROM wins)
        SELECT e.doc_id, CAST(e.window_no AS bigint) window_no, CAST(n_visible AS bigint) n_visible,
          CAST(512 AS bigint) width, CAST(coalesce(s.second_id, 2) AS bigint) second_id,
          CAST(coalesce(s.s, 0) + 2 * n_visible + (512 * 513 - n_visible * (n_visible + 1)) // 2 AS bigint) checksum
        FROM ends e LEFT JOIN summed s USING (doc_id, window_no)"""

_REQUEST_ROWS = r"""WITH hosts AS (SELECT page_id // 25 job, page_id, html, url,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) host FROM pages),
rows AS (SELECT *, row_number() OVER (PARTITION BY job ORDER BY page_id) - 1 pos FROM hosts),
good AS (SELECT concat('job', job) job_id, pos, host domain_name, html body_text, url meta_text,
  CASE WHEN job % 2 = 0 THEN concat(host, '-', pos) ELSE cast(page_id AS varchar) END visit_id,
  CASE WHEN job % 3 = 0 THEN '' ELSE url END external_hosts
  FROM rows WHERE job % 7 NOT IN (3, 5))
"""


def _numeric() -> str:
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"):
        raw = f"CAST({'nullif(l_discount, 0)' if c == 'l_discount' else c} AS double)"
        parts.append(
            f"SELECT '{c}' AS \"name\", median(v) m, (SELECT avg(coalesce({raw}, m2.m)) FROM lineitem, "
            f"(SELECT median({raw}) m FROM lineitem) m2) mean, (SELECT stddev_pop(coalesce({raw}, m2.m)) "
            f"FROM lineitem, (SELECT median({raw}) m FROM lineitem) m2) std FROM (SELECT {raw} v FROM lineitem) t"
        )
    return " UNION ALL ".join(parts)


_LABELLED = _with("", "visits_quality", "visits_toxic", "html_features").rstrip()

ORACLE: dict[str, str] = {
    "training_rows": _LABELLED + """
        SELECT f.*, v.label, v.table_no, CAST(0 AS bigint) vote_ord FROM
        (SELECT *, 0 table_no FROM visits_quality UNION ALL SELECT *, 1 FROM visits_toxic) v
        JOIN html_features f USING (visit_id)""",
    "prediction_rows": _LABELLED + """
        SELECT f.* FROM (SELECT visit_id FROM visits_quality UNION ALL SELECT visit_id FROM visits_toxic) v
        JOIN html_features f USING (visit_id)""",
    "test_set_votes": _LABELLED + """
        SELECT v.visit_id, v.table_no, v.label FROM
        (SELECT *, 0 table_no FROM visits_quality UNION ALL SELECT *, 1 FROM visits_toxic) v
        JOIN html_features f USING (visit_id) WHERE v.label <> 'Clean'""",
    "test_set_lists": _LABELLED + """
        SELECT v.visit_id, string_agg(v.label, '|' ORDER BY v.table_no) labels FROM
        (SELECT *, 0 table_no FROM visits_quality UNION ALL SELECT *, 1 FROM visits_toxic) v
        JOIN html_features f USING (visit_id) WHERE v.label <> 'Clean' GROUP BY 1""",
    "test_set_pages": _LABELLED + """
        SELECT f.* FROM html_features f WHERE visit_id IN (SELECT visit_id FROM visits_quality)
        OR visit_id IN (SELECT visit_id FROM visits_toxic WHERE label <> 'Clean')""",
    "normalise_columns": _with("SELECT * FROM html_features", "html_features"),
    "drop_ignored_lists": _LISTED + """ SELECT visit_id, string_agg(label, '|' ORDER BY vote_ord) labels
        FROM votes WHERE label NOT IN ('Skip', 'Poor') GROUP BY 1""",
    "absorb_labels": _LABELLED + """
        SELECT 'labelled' part, label, count(*) n FROM (SELECT label FROM visits_quality
        UNION ALL SELECT label FROM visits_toxic) t GROUP BY label
        UNION ALL SELECT 'pool', '', count(*) FROM html_features
        WHERE visit_id NOT IN (SELECT visit_id FROM visits_toxic)""",
    "votes_majority": _with("""SELECT visit_id, CAST(n_votes AS bigint) n_votes, n_labels, top_votes, top_label,
        has_majority, unanimous FROM judged""", *_JUDGED),
    "list_majority": _LISTED + """ SELECT visit_id, CAST(n_votes AS bigint) n_votes, n_labels, top_votes, top_label,
        has_majority, unanimous FROM judged""",
    "encode_binary_votes": _with("""SELECT visit_id, count(*) n_votes, CAST(sum(y) AS bigint) n_positive,
        (sum(y) = 0 OR sum(y) = count(*)) unanimous, 2*sum(y) <> count(*) has_majority, 2*sum(y) > count(*) positive
        FROM (SELECT visit_id, CASE WHEN label = 'Poor' THEN 1 ELSE 0 END y FROM visits_quality) t GROUP BY 1""",
        "visits_quality"),
    "multiclass_metrics": _MULTI,
    "multiclass_metrics_lists": _LISTED + f""", {_UNIVERSE1}
        SELECT population, metric, label, round(value, 6) AS value FROM {_multiclass('pred1', 'value')} m""",
    "inclusion_rate": _with("""SELECT round(avg(hit), 6) included_all,
        round(avg(hit) FILTER (WHERE n_labels > 1), 6) included_controversial FROM (
        SELECT v.visit_id, count(DISTINCT v.label) n_labels,
          max(CASE WHEN v.label = p.predicted_label THEN 1.0::double ELSE 0.0 END) hit
        FROM votes v JOIN (
          SELECT DISTINCT concat(cast(e.user_id AS varchar), '-', cast(cast(e.ts AS date) AS varchar)) visit_id, u.predicted_label
          FROM events e JOIN (SELECT user_id, event_type predicted_label FROM (SELECT *, row_number() OVER
            (PARTITION BY user_id ORDER BY value DESC, event_id) r FROM events) q WHERE r = 1) u USING (user_id)
        ) p USING (visit_id) GROUP BY 1) t""", "votes"),
    "compare_models": _with("", *_JUDGED, "pred1", "pred2").rstrip() + f""", {_UNIVERSE2}
        SELECT population, metric, label, round(a.first, 6) AS "first", round(b.second, 6) AS "second",
          round(b.second - a.first, 6) AS delta
        FROM {_multiclass('pred1', '"first"')} a JOIN {_multiclass('pred2', '"second"')} b
        USING (population, metric, label)""",
    "binary_metrics": _with("", *_BINARY).rstrip() + f"""
        SELECT population, metric, round(value, 6) AS value FROM {_binary('scores', 'value')} m""",
    "compare_binary": _with("", *_BINARY, "low_scores").rstrip() + f"""
        SELECT population, metric, round(a.first, 6) AS "first", round(b.second, 6) AS "second",
          round(b.second - a.first, 6) AS delta
        FROM {_binary('scores', '"first"')} a JOIN {_binary('low_scores', '"second"')} b USING (population, metric)""",
    "pr_curve": _CURVE + """SELECT round(threshold, 6) threshold, round("precision", 6) AS "precision",
        round(recall, 6) recall FROM curve""",
    "pr_summary": _CURVE + """, steps AS (SELECT *, lag(recall) OVER o pr, lag("precision") OVER o pp FROM curve
          WINDOW o AS (ORDER BY threshold DESC NULLS FIRST)),
        best AS (SELECT *, 2*"precision"*recall/nullif("precision"+recall, 0) f1 FROM curve),
        top AS (SELECT * FROM best ORDER BY f1 DESC NULLS LAST, threshold LIMIT 1)
        SELECT round((SELECT sum((recall - pr) * ("precision" + pp) / 2) FROM steps), 6) auc_pr,
          round(f1, 6) best_f1, round(threshold, 6) threshold, round("precision", 6) AS "precision",
          round(recall, 6) recall FROM top""",
    "confusion_table": _CONFUSION + """SELECT true_label, CAST(true_rank AS integer) true_rank, predicted_label, n,
        round(share, 6) AS "percent" FROM shares""",
    "confusion_matrix": _CONFUSION + "SELECT true_label, " + ", ".join(
        f"""round(max(share) FILTER (WHERE predicted_label = '{c}'), 6) AS "{c}" """
        for c in ("click", "error", "purchase", "signup", "view")
    ) + " FROM shares GROUP BY true_label",
    "confusion_binary": _with("""SELECT count(*) FILTER (WHERE NOT d AND NOT t) tn, count(*) FILTER (WHERE d AND NOT t) fp,
        count(*) FILTER (WHERE NOT d AND t) fn, count(*) FILTER (WHERE d AND t) tp FROM (
        SELECT s.prediction > 0.98 d, CASE WHEN 2*b.pos = b.n THEN f.y = 1 ELSE 2*b.pos > b.n END t
        FROM bpages b JOIN scores s USING (visit_id) JOIN votes_binary f ON f.visit_id = b.visit_id AND f.vote_ord = 1) x""",
        "votes", "votes_binary", "scores", "bpages"),
    "label_distribution": _with("""SELECT predicted_label AS label, count(*) n,
        round(100.0::double * count(*) / sum(count(*)) OVER (), 6) AS "percent" FROM pred1 GROUP BY 1""", "votes", "pred1"),
    "combine_predictions": _BALLOTS + "SELECT visit_id, CASE WHEN b = c THEN b ELSE a END predicted_label FROM ballots",
    "combine_majority_only": _BALLOTS + """SELECT visit_id, CASE WHEN b = c THEN b ELSE a END predicted_label
        FROM ballots WHERE a = b OR a = c OR b = c""",
    "combine_decisions": _with("""SELECT s.visit_id,
        (s.prediction > 0.98)::int + (l.prediction > 0.98)::int + (s.prediction > 0.99)::int >= 2 decision
        FROM scores s JOIN low_scores l USING (visit_id)""", "votes", "scores", "low_scores"),
    "rank_uncertain": _SOFTMAX + """SELECT cast(vec_id AS varchar) visit_id,
        round(list_sum([-x * ln(x) for x in v]), 6) entropy FROM p""",
    "top_uncertain": _SOFTMAX + """, h AS (SELECT cast(vec_id AS varchar) visit_id,
        list_sum([-x * ln(x) for x in v]) entropy FROM p)
        SELECT visit_id, round(entropy, 6) entropy FROM (SELECT * FROM h ORDER BY entropy DESC, visit_id LIMIT 50) t""",
    "recombine_windows": _SOFTMAX + """, u AS (SELECT vec_id // 2 page_id, unnest(v) x, generate_subscripts(v, 1) i FROM p),
        m AS (SELECT page_id, i, avg(x) x FROM u GROUP BY 1, 2)
        SELECT page_id, arg_min(i, row(-x, i)) - 1 class_index, round(max(x), 6) top_probability,
          round(sum(-x * ln(x)), 6) entropy FROM m GROUP BY page_id""",
    "binary_decisions": _with("""SELECT visit_id, round(prediction, 6) prediction, prediction > 0.98 decision
        FROM scores""", "votes", "scores"),
    "domain_strip": r"""WITH n AS (SELECT cast(page_id AS varchar) visit_id,
          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1) domain_name FROM pages
          UNION ALL SELECT cast(doc_id AS varchar), concat('site', doc_id, '.', lang) FROM documents),
        s AS (SELECT *, regexp_replace(domain_name, '\.[^.]*$', '') stripped FROM n)
        SELECT *, regexp_replace(lower(stripped), '[^a-z0-9]', '', 'g') clean FROM s""",
    "hosts_join": r"""SELECT cast(doc_id AS varchar) visit_id,
        array_to_string(regexp_extract_all(text, '[A-Za-z]+\.'), ' ') hosts FROM documents""",
    "count_tag": """SELECT page_id, len(string_split(html, '<')) - 1 n_open, len(string_split(html, 'p')) - 1 n_p
        FROM pages""",
    "model_text": """SELECT cast(doc_id AS varchar) visit_id,
        concat('site', doc_id, '. ', coalesce(source, ''), ' ', text) model_text FROM documents""",
    "text_chunks": """WITH w AS (SELECT doc_id, string_split(text, ' ') w FROM documents),
        c AS (SELECT doc_id, w, unnest(range(0, (len(w) + 99) // 100)) chunk_no FROM w)
        SELECT doc_id, chunk_no, len(w[chunk_no*100+1 : chunk_no*100+100]) n,
          array_to_string(w[chunk_no*100+1 : chunk_no*100+100], ' ') chunk FROM c""",
    "vocabulary": _VOCABULARY + "SELECT token, n, token_id FROM vocab",
    "token_windows": _VOCABULARY + """, ids AS (SELECT f.doc_id, f.pos, f.n, coalesce(v.token_id, 3) id
          FROM flat f LEFT JOIN vocab v USING (token)), """ + _WINDOW_SUMS,
    "gram_counts": """WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') w FROM documents),
        g AS (SELECT unnest(w) gram FROM w UNION ALL
              SELECT unnest([concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))]) FROM w)
        SELECT gram, CAST(count(*) AS double) n FROM g GROUP BY gram""",
    "numeric_state": f"""SELECT "name", round(m, 6) "median", round(mean, 6) mean, round(std, 6) std FROM ({_numeric()}) t""",
    "impute_scale": "WITH s AS (" + _numeric() + """)
        SELECT l_orderkey, l_linenumber, l_partkey, """ + ", ".join(
        f"""round((coalesce(CAST({'nullif(l_discount, 0)' if c == 'l_discount' else c} AS double),
          (SELECT m FROM s WHERE "name" = '{c}')) - (SELECT mean FROM s WHERE "name" = '{c}'))
          / (SELECT std FROM s WHERE "name" = '{c}'), 6) AS z_{c}"""
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")
    ) + " FROM lineitem",
    "tfidf": r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[^\s]+')) term FROM documents),
        c AS (SELECT doc_id, term, count(*) tf FROM t GROUP BY 1, 2),
        i AS (SELECT term, ln((1.0::double + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 idf FROM c GROUP BY 1),
        w AS (SELECT doc_id, term, tf * idf w FROM c JOIN i USING (term)),
        n AS (SELECT doc_id, sqrt(sum(w * w)) norm FROM w GROUP BY 1)
        SELECT doc_id, term, round(w / norm, 6) w FROM w JOIN n USING (doc_id)""",
    "host_idf": """WITH c AS (SELECT DISTINCT l_orderkey, concat('supplier', l_suppkey, '.example') term FROM lineitem)
        SELECT term, count(*) df, round(ln((1.0::double + (SELECT count(DISTINCT l_orderkey) FROM lineitem))
          / (1 + count(*))) + 1, 6) idf FROM c GROUP BY term""",
    "stratified_split": """WITH v AS (SELECT concat(CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END, '/',
          CASE WHEN toxic = 1 THEN 'Toxic' ELSE 'Clean' END) label FROM labels),
        c AS (SELECT label, count(*) n, sum(count(*)) OVER () total FROM v GROUP BY 1),
        t AS (SELECT *, total - CAST(ceil(0.15 * total) AS bigint) n_train FROM c),
        q AS (SELECT *, (n * n_train) // total whole, (n * n_train) % total rest FROM t),
        r AS (SELECT *, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, label)
              <= n_train - sum(whole) OVER () THEN 1 ELSE 0 END train FROM q)
        SELECT label, 'train' "split", CAST(train AS bigint) n FROM r WHERE train > 0
        UNION ALL SELECT label, 'val', CAST(n - train AS bigint) FROM r WHERE n > train""",
    "label_index": """SELECT event_type AS label, row_number() OVER (ORDER BY event_type) - 1 label_index
        FROM (SELECT DISTINCT event_type FROM events) t""",
    "model_info": """SELECT CASE WHEN count(DISTINCT quality) = 2 THEN 'binary' ELSE 'multi' END kind,
        CAST(count(DISTINCT quality) AS integer) n_labels, count(DISTINCT quality) = 2 has_threshold FROM labels""",
    "explode_requests": _REQUEST_ROWS + "SELECT job_id, pos, visit_id, domain_name, body_text, meta_text, external_hosts FROM good",
    "rejected_requests": """SELECT DISTINCT concat('job', page_id // 25) job_id,
        CASE WHEN (page_id // 25) % 5 = 4 THEN 'm2' ELSE 'm1' END model,
        CASE WHEN (page_id // 25) % 7 = 3 THEN 'meta_text is not as long as domain_name'
             ELSE 'body_text is not as long as domain_name' END reason, CAST(NULL AS varchar) bad_line
        FROM pages WHERE (page_id // 25) % 7 IN (3, 5)""",
    "fold_responses": _REQUEST_ROWS + """SELECT job_id, concat(
        '{"visit_id":[', string_agg(concat('"', visit_id, '"'), ',' ORDER BY pos),
        '],"category":[', string_agg(concat('"L', len(body_text) % 3, '"'), ',' ORDER BY pos), ']}') response
        FROM good GROUP BY job_id""",
}
ORACLE["token_windows_joined"] = ORACLE["token_windows"]
ORACLE["subword_vocabulary"] = _SUBWORDS + """SELECT r.id token_id, r.piece, count(*) n
    FROM (SELECT unnest(parts) piece FROM placed JOIN spelled USING (word)) u JOIN ranks r USING (piece) GROUP BY 1, 2"""
ORACLE["subword_windows"] = _SUBWORDS.rstrip() + """,
toks AS (SELECT c.doc_id, coalesce(x.w, []) w FROM cut c LEFT JOIN (
  SELECT doc_id, flatten(list(parts ORDER BY pos)) w FROM placed JOIN spelled USING (word) GROUP BY doc_id) x USING (doc_id)),
ids AS (SELECT doc_id, pos, n, id FROM (
  SELECT doc_id, unnest(w) piece, generate_subscripts(w, 1) pos, len(w) n FROM toks) JOIN ranks USING (piece)),
""" + _WINDOW_SUMS

# The best way to each word of a name, by its place, its start and the number of words before it.
ORACLE["segment_domains"] = r"""WITH RECURSIVE grams AS (""" + ORACLE["gram_counts"] + r"""),
total AS (SELECT sum(n) t FROM grams WHERE instr(gram, ' ') = 0),
hosts AS (SELECT DISTINCT coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)', 1), '') domain_name FROM pages),
names AS (SELECT domain_name, regexp_replace(lower(regexp_replace(domain_name, '\.[^.]*$', '')), '[^a-z0-9]', '', 'g') clean FROM hosts),
spans AS (SELECT clean, i, j, substr(clean, i + 1, j - i) word FROM (
  SELECT clean, i, unnest(range(i + 1, least(i + 24, length(clean)) + 1)) j FROM (
    SELECT clean, unnest(range(0, length(clean))) i FROM (SELECT DISTINCT clean FROM names) a) b) c),
alone AS (SELECT spans.*, n, log10(coalesce(n / t, 10.0::DOUBLE / (t * 10.0::DOUBLE ** length(word)))) score
  FROM spans LEFT JOIN grams ON gram = word, total),
ways AS (
  SELECT clean, j, word, n, {'score': score, 'words': [word]} best FROM alone WHERE i = 0
  UNION ALL
  SELECT clean, j, word, any_value(n), max({'score': s, 'words': words}) FROM (
    SELECT a.clean, a.j, a.word, a.n, list_append(w.best.words, a.word) words,
      w.best.score + CASE WHEN w.n IS NOT NULL AND g.n IS NOT NULL THEN log10(g.n / t / (w.n / t)) ELSE a.score END s
    FROM ways w JOIN alone a ON a.clean = w.clean AND a.i = w.j LEFT JOIN grams g ON g.gram = w.word || ' ' || a.word, total) x
  GROUP BY clean, j, word, length(array_to_string(words[:-2], '')))
SELECT domain_name, coalesce(array_to_string(best.words, ' '), '') domain_segmented FROM names LEFT JOIN (
  SELECT clean, max(best) best FROM ways WHERE j = length(clean) GROUP BY clean) b USING (clean)"""
ORACLE["segment_domains_filtered"] = ORACLE["segment_domains_lists"] = ORACLE["segment_domains"]

ORACLE["stream_responses"] = "SELECT job_id, 'done' status, 0 part, response FROM (" + ORACLE["fold_responses"] + """) f
    UNION ALL SELECT job_id, 'refused', 0, concat('{"error": "', reason, '"}') FROM (""" + ORACLE["rejected_requests"] + ") r"

ORACLE["unmatched_pages"] = _with("", *_JUDGED, "pred1").rstrip() + """,
part AS (SELECT * FROM pred1 WHERE visit_id NOT LIKE '%1'
  UNION ALL SELECT visit_id || 'x', predicted_label FROM pred1 WHERE visit_id LIKE '%2'),
number(visit_id, x) AS (SELECT visit_id, CAST('0x' || substr(md5(visit_id), 1, 12) AS BIGINT) FROM (
  SELECT visit_id FROM judged UNION SELECT visit_id FROM part)),
both_sides AS (SELECT j.visit_id a, s.visit_id b, top_label, predicted_label FROM judged j FULL JOIN part s USING (visit_id))
SELECT count(*) FILTER (WHERE a IS NOT NULL AND b IS NOT NULL) matched, count(*) FILTER (WHERE b IS NULL) only_votes,
  count(*) FILTER (WHERE a IS NULL) only_predictions, CAST(sum(x.x) AS VARCHAR) vote_keys, CAST(sum(y.x) AS VARCHAR) prediction_keys,
  count(*) FILTER (WHERE top_label = predicted_label) agreeing
FROM both_sides LEFT JOIN number x ON x.visit_id = a LEFT JOIN number y ON y.visit_id = b"""

ORACLE["window_store"] = "SELECT * FROM (SELECT row_number() OVER (ORDER BY doc_id % 2, doc_id, chunk_no) - 1 row_no, * FROM (" \
    + ORACLE["text_chunks"] + ") c) r WHERE row_no % 7 = 0"
