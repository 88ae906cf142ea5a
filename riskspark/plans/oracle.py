"""DuckDB SQL for every registered query: an independent statement of the same semantics,
run by the driver on the same parquet tables (views named after the tables)."""

from __future__ import annotations

NL = "chr(10)"
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"

VERDICT = r"\s*\*?\*?Final\s*[Aa]ssessment\*?\*?\s*:\s*(good|bad)\*?\*?"
RISK = r"\s*\*?\*?Default\s*[Rr]isk\*?\*?\s*:\s*((?:[1-9]|[1-9][0-9]|100))\b\*?\*?"
STRICT = r"Final assessment: (good|bad)\s*\nDefault risk: (100|[1-9][0-9]|[1-9])\s*$"
LOOSE = r"Final assessment: (good|bad)\s*\nDefault risk: (100|[1-9][0-9]|[1-9])"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def word_label(x: str) -> str:
    return f"(CASE WHEN contains({x}, 'good') THEN 0 WHEN contains({x}, 'bad') THEN 1 END)"


def last_segment(x: str) -> str:
    return strip(f"replace(string_split(lower({x}), 'final assessment')[-1], ':', '')")


def strict_v(x):
    return f"(CASE WHEN regexp_matches({x}, '{STRICT}') THEN regexp_extract({x}, '{STRICT}', 1) END)"


def strict_r(x):
    return f"(CASE WHEN regexp_matches({x}, '{STRICT}') THEN CAST(regexp_extract({x}, '{STRICT}', 2) AS INTEGER) END)"


def loose_v(x):
    return f"(CASE WHEN regexp_matches({x}, '{LOOSE}') THEN regexp_extract({x}, '{LOOSE}', 1) END)"


def loose_r(x):
    return f"(CASE WHEN regexp_matches({x}, '{LOOSE}') THEN CAST(regexp_extract({x}, '{LOOSE}', 2) AS INTEGER) END)"


def answer_label(x):
    return f"(CASE WHEN {loose_v(x)} IS NOT NULL THEN {word_label(strip(loose_v(x)))} ELSE {word_label(last_segment(x))} END)"


def think_ok(x):
    return (
        f"(starts_with({x}, '<think>' || {NL}) AND (length({x}) - length(replace({x}, '<think>', ''))) = 7 "
        f"AND strpos({x}, '</think>') > 0 AND substr({x}, strpos({x}, '</think>') + 8, 1) = {NL})"
    )


# ----------------------------------------------------------------------------- proxies

PREDICTIONS = f"""
li_ar AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS lab FROM lineitem WHERE l_returnflag IN ('A', 'R')),
li_k AS (SELECT *, (l_orderkey * 31 + l_linenumber * 17 + lab * 200) % 1000 AS k FROM li_ar),
predictions AS (
  SELECT o_orderpriority AS model, {KEY}, lab AS label,
         CAST(1000 - k AS DOUBLE) / 1000 AS good_prob, CAST(k AS DOUBLE) / 1000 AS bad_prob,
         CASE WHEN l_partkey % 17 = 0 THEN NULL WHEN k > 500 THEN 1 ELSE 0 END AS pred_label
  FROM li_k JOIN orders ON l_orderkey = o_orderkey)"""

_WORD = "CASE WHEN (l_returnflag = 'R') <> (l_partkey % 4 = 0) THEN 'bad' ELSE 'good' END"
ANSWERS = f"""
li_r AS (SELECT *, CAST(l_partkey % 100 + 1 AS INTEGER) AS risk, (l_orderkey + l_linenumber) % 6 AS v, {_WORD} AS word FROM lineitem),
answers AS (
  SELECT {KEY},
    CASE v
      WHEN 0 THEN 'Reasoning about order ' || l_orderkey || '.' || {NL} || {NL} || 'Final assessment: ' || word || {NL} || 'Default risk: ' || risk
      WHEN 1 THEN 'Line ' || l_linenumber || ' looks fine.' || {NL} || {NL} || 'Final assessment: ' || word || {NL} || 'Default risk: ' || risk || {NL} || 'That is my answer.'
      WHEN 2 THEN 'Checking part ' || l_partkey || '.' || {NL} || {NL} || '**Final assessment**: ' || word
      WHEN 3 THEN 'SUPPLIER ' || l_suppkey || ' REVIEWED.' || {NL} || {NL} || 'FINAL ASSESSMENT: ' || upper(word)
      WHEN 4 THEN 'I cannot decide about order ' || l_orderkey || '.'
      ELSE '<think>' || {NL} || 'weigh order ' || l_orderkey || '</think>' || {NL} || 'Final assessment: ' || word || {NL} || 'Default risk: ' || risk
    END AS response,
    CASE WHEN l_returnflag = 'R' THEN 'bad' ELSE 'good' END AS expected,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
  FROM li_r)"""

CANDIDATES = f"""{ANSWERS},
candidates AS (
  SELECT l_orderkey AS prompt_id,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INTEGER) AS pos,
         response,
         {answer_label('response')} AS pred_label,
         coalesce(1.0 - {loose_r('response')} / 100.0, 0.5) AS good_prob,
         coalesce({loose_r('response')} / 100.0, 0.5) AS bad_prob,
         CAST(l_orderkey % 3 = 0 AS INTEGER) AS label,
         [CAST((l_partkey * 7) % 100 AS DOUBLE) / 100,
          CAST((l_suppkey * 11 + l_linenumber) % 100 AS DOUBLE) / 100,
          CAST((l_orderkey * 13 + l_partkey) % 100 AS DOUBLE) / 100] AS step_good_probs
  FROM answers)"""

TRAJ = """
ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events),
t0 AS (
  SELECT user_id AS traj_id, step, event_id, value AS reward, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS v,
         event_type = 'error' AS done,
         -CAST((event_id * 13) % 100 + 1 AS DOUBLE) / 100 AS logp_old,
         -CAST((event_id * 17) % 100 + 1 AS DOUBLE) / 100 AS logp_new,
         CAST(event_id % 50 AS DOUBLE) / 100 AS entropy
  FROM ev),
trajectories AS (
  SELECT a.*, coalesce(b.v, 0.0) AS next_value FROM t0 a LEFT JOIN t0 b ON a.traj_id = b.traj_id AND b.step = a.step + 1)"""

# ----------------------------------------------------------------------------- metrics


def _curve(src: str, label: str, score: str, by: str) -> str:
    return f"""
pts AS (SELECT {by}, {score} AS score, SUM(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS pos,
               SUM(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY ALL),
cum AS (SELECT *, SUM(pos) OVER w AS cum_pos, SUM(neg) OVER w AS cum_neg,
               SUM(pos) OVER (PARTITION BY {by}) AS P, SUM(neg) OVER (PARTITION BY {by}) AS N
        FROM pts WINDOW w AS (PARTITION BY {by} ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curve AS (SELECT {by}, score, pos, neg,
               CAST(cum_pos AS DOUBLE) / nullif(P, 0) AS tpr, CAST(cum_neg AS DOUBLE) / nullif(N, 0) AS fpr,
               CAST(cum_pos AS DOUBLE) / nullif(cum_pos + cum_neg, 0) AS precision,
               CAST(cum_pos - pos AS DOUBLE) / nullif(P, 0) AS prev_tpr, CAST(cum_neg - neg AS DOUBLE) / nullif(N, 0) AS prev_fpr,
               coalesce(CAST(cum_pos - pos AS DOUBLE) / nullif(cum_pos - pos + cum_neg - neg, 0), 1.0) AS prev_precision
        FROM cum),
cm AS (SELECT {by}, SUM((fpr - prev_fpr) * (tpr + prev_tpr) / 2) AS roc_auc,
              SUM((tpr - prev_tpr) * (precision + prev_precision) / 2) AS pr_auc,
              greatest(0.0, MAX(tpr - fpr)) AS ks_signed, MAX(abs(tpr - fpr)) AS ks FROM curve GROUP BY ALL)"""


def _label_metrics(src: str, label: str, pred: str, by: str) -> str:
    return f"""
lm AS (SELECT {by},
         CAST(SUM(CASE WHEN {pred} IS NOT NULL AND {pred} = {label} THEN 1 ELSE 0 END) AS DOUBLE) / nullif(COUNT({pred}), 0) AS accuracy,
         coalesce(CAST(2 * SUM(CASE WHEN {pred} = 1 AND {label} = 1 THEN 1 ELSE 0 END) AS DOUBLE) /
           nullif(2 * SUM(CASE WHEN {pred} = 1 AND {label} = 1 THEN 1 ELSE 0 END)
                  + SUM(CASE WHEN {pred} = 1 AND {label} <> 1 THEN 1 ELSE 0 END)
                  + SUM(CASE WHEN {pred} <> 1 AND {label} = 1 THEN 1 ELSE 0 END), 0), 0.0) AS f1,
         CAST(COUNT(*) - COUNT({pred}) AS DOUBLE) / nullif(COUNT(*), 0) AS miss_pct,
         COUNT({pred}) AS num_valid, COUNT(*) AS num_total
       FROM {src} GROUP BY ALL)"""


R6_METRICS = """round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(miss_pct, 6) AS miss_pct, num_valid, num_total,
  round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc, round(ks_signed, 6) AS ks_signed, round(ks, 6) AS ks"""

Q: dict[str, str] = {}

Q["metrics_by_model"] = f"""WITH {PREDICTIONS}, {_curve('predictions', 'label', 'bad_prob', 'model')},
{_label_metrics('predictions', 'label', 'pred_label', 'model')}
SELECT model, {R6_METRICS} FROM lm JOIN cm USING (model)"""

Q["metrics_from_scores"] = f"""WITH {PREDICTIONS},
p2 AS (SELECT *, CASE WHEN bad_prob > 0.5 THEN 1 ELSE 0 END AS _pred FROM predictions),
{_curve('p2', 'label', 'bad_prob', 'model')}, {_label_metrics('p2', 'label', '_pred', 'model')}
SELECT model, {R6_METRICS} FROM lm JOIN cm USING (model)"""

Q["roc_points"] = f"""WITH {PREDICTIONS}, {_curve('predictions', 'label', 'bad_prob', 'model')}
SELECT model, round(score, 6) AS score, pos, neg, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr, round(precision, 6) AS precision FROM curve"""

Q["best_model"] = f"""WITH {PREDICTIONS}, {_curve('predictions', 'label', 'bad_prob', 'model')},
{_label_metrics('predictions', 'label', 'pred_label', 'model')},
m AS (SELECT * FROM lm JOIN cm USING (model) WHERE roc_auc IS NOT NULL AND NOT isnan(roc_auc)),
ranked AS (SELECT *, row_number() OVER (ORDER BY roc_auc DESC, model) AS rn FROM m)
SELECT model, round(roc_auc, 6) AS roc_auc, round(accuracy, 6) AS accuracy FROM ranked WHERE rn = 1"""

# ----------------------------------------------------------------------------- parsing and rewards

_R = "response"
Q["answer_parse"] = f"""WITH {ANSWERS}
SELECT {KEY},
  CASE WHEN lower({strip(_R)}) = 'good' THEN 0 WHEN lower({strip(_R)}) = 'bad' THEN 1 END AS exact_label,
  {word_label(last_segment(_R))} AS segment_label,
  string_split(replace(replace(replace(regexp_extract_all({_R}, '{VERDICT}', 0)[-1], {NL} || {NL}, ''), {NL}, ''), '*', ''), ':')[-1] AS last_verdict,
  {strict_v(_R)} AS strict_verdict, {strict_r(_R)} AS strict_risk,
  {loose_v(_R)} AS loose_verdict, {loose_r(_R)} AS loose_risk,
  CAST(nullif(regexp_extract({_R}, '{RISK}', 1), '') AS INTEGER) AS risk,
  {answer_label(_R)} AS pred_label,
  round(coalesce(1.0 - {loose_r(_R)} / 100.0, 0.5), 6) AS good_prob,
  round(coalesce({loose_r(_R)} / 100.0, 0.5), 6) AS bad_prob,
  contains(string_split(lower({_R}), 'final assessment')[-1], lower(expected)) AS correct,
  {think_ok(_R)} AS think_ok
FROM answers"""

REWARDS = f"""{ANSWERS},
rewards AS (
  SELECT {KEY}, expected, response,
    CASE WHEN {think_ok(_R)} AND regexp_matches({_R}, '{STRICT}') THEN 1.5e0 ELSE -1.5e0 END AS r_format,
    CASE WHEN {strict_v(_R)} IS NULL THEN -0.5e0 WHEN {strip(strict_v(_R))} = expected THEN 2.0e0 ELSE -2.0e0 END AS r_accuracy,
    CASE WHEN {strict_r(_R)} IS NULL THEN -0.5
         WHEN (expected = 'good' AND {strict_r(_R)} < 30) OR (expected = 'bad' AND {strict_r(_R)} > 70) THEN 2.0e0 ELSE -2.0e0 END AS r_risk,
    CASE WHEN contains(string_split(lower({_R}), 'final assessment')[-1], lower(expected)) THEN 1.0e0 ELSE 0.0e0 END AS r_outcome
  FROM answers),
rw AS (SELECT *, r_format + r_accuracy + r_risk + r_outcome AS reward FROM rewards)"""

Q["answer_rewards"] = f"""WITH {REWARDS}
SELECT {KEY}, r_format, r_accuracy, r_risk, r_outcome, reward FROM rw"""

Q["reward_summary"] = f"""WITH {REWARDS}
SELECT expected, round(avg(r_format), 6) AS mean_r_format, round(avg(r_accuracy), 6) AS mean_r_accuracy,
  round(avg(r_risk), 6) AS mean_r_risk, round(avg(r_outcome), 6) AS mean_r_outcome, round(avg(reward), 6) AS mean_reward
FROM rw GROUP BY expected"""

Q["group_advantages"] = f"""WITH {REWARDS},
st AS (SELECT l_orderkey, avg(reward) AS m, stddev_samp(reward) AS s FROM rw GROUP BY l_orderkey)
SELECT {KEY}, reward, round((reward - m) / (s + 1e-4), 6) AS advantage FROM rw JOIN st USING (l_orderkey)"""

Q["global_advantages"] = f"""WITH {TRAJ},
st AS (SELECT avg(reward) AS m, stddev_pop(reward) AS s FROM trajectories),
g AS (SELECT traj_id, step, done, (reward - m) / (s + 1e-8) AS advantage FROM trajectories, st),
g0 AS (SELECT *, CASE WHEN done THEN 0.0 ELSE advantage END AS adv0 FROM g),
st2 AS (SELECT avg(nullif(adv0, 0.0)) AS m2, stddev_pop(nullif(adv0, 0.0)) AS s2 FROM g0)
SELECT traj_id, step, round(advantage, 6) AS advantage, round((adv0 - m2) / (s2 + 1e-8), 6) AS adv_norm FROM g0, st2"""

# ----------------------------------------------------------------------------- rerank and vote

_BEST = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY score DESC NULLS LAST, pos) AS rn FROM scored)"""

Q["best_of_n_min"] = f"""WITH {CANDIDATES},
scored AS (SELECT *, list_min(step_good_probs) AS score FROM candidates), {_BEST}
SELECT prompt_id, pos, round(score, 6) AS score, pred_label, label FROM ranked WHERE rn = 1"""

Q["best_of_n_prod"] = f"""WITH {CANDIDATES},
scored AS (SELECT *, step_good_probs[1] * step_good_probs[2] * step_good_probs[3] AS score FROM candidates), {_BEST}
SELECT prompt_id, pos, round(score, 6) AS score, pred_label, label FROM ranked WHERE rn = 1"""

Q["best_of_n_metrics"] = f"""WITH {CANDIDATES},
scored AS (SELECT *, list_min(step_good_probs) AS score FROM candidates), {_BEST},
best AS (SELECT *, 'best_of_n' AS method FROM ranked WHERE rn = 1),
{_curve('best', 'label', 'bad_prob', 'method')}, {_label_metrics('best', 'label', 'pred_label', 'method')}
SELECT method, {R6_METRICS} FROM lm JOIN cm USING (method)"""

_MAJ = """
cnt AS (SELECT prompt_id, pred_label AS lab, COUNT(*) AS n, MIN(pos) AS first_pos FROM candidates GROUP BY prompt_id, pred_label),
maj AS (SELECT prompt_id, lab AS majority_label, n AS votes,
               row_number() OVER (PARTITION BY prompt_id ORDER BY n DESC, first_pos) AS rn FROM cnt)"""

Q["majority_vote"] = f"""WITH {CANDIDATES}, {_MAJ}
SELECT prompt_id, majority_label, votes FROM maj WHERE rn = 1"""

Q["vote_pick"] = f"""WITH {CANDIDATES}, {_MAJ},
w AS (SELECT c.*, md5(CAST(c.prompt_id AS VARCHAR) || ':' || CAST(c.pos AS VARCHAR) || ':7') AS h
      FROM candidates c JOIN maj m ON c.prompt_id = m.prompt_id AND m.rn = 1
      WHERE c.pred_label IS NOT DISTINCT FROM m.majority_label),
p AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY h) AS rn2 FROM w)
SELECT prompt_id, pos, pred_label, label FROM p WHERE rn2 = 1"""

# ----------------------------------------------------------------------------- trajectories

G, LAM = 0.95, 0.95
_GL = repr(G * LAM)
GAE = f"""{TRAJ},
d AS (SELECT traj_id, step, v, (reward + {G}e0 * next_value * (1.0e0 - CAST(done AS DOUBLE))) - v AS delta,
             {_GL}e0 * (1.0e0 - CAST(done AS DOUBLE)) AS coef,
             MAX(step) OVER (PARTITION BY traj_id) AS last_step FROM trajectories),
rec AS (
  SELECT traj_id, step, delta AS adv FROM d WHERE step = last_step
  UNION ALL
  SELECT d.traj_id, d.step, d.delta + d.coef * rec.adv FROM d JOIN rec ON d.traj_id = rec.traj_id AND d.step = rec.step - 1),
g AS (SELECT t.*, rec.adv AS advantage, t.v + rec.adv AS ret FROM trajectories t JOIN rec USING (traj_id, step))"""

Q["gae_advantages"] = f"""WITH RECURSIVE {GAE}
SELECT traj_id, step, round(advantage, 6) AS advantage, round(ret, 6) AS ret FROM g"""

Q["ppo_losses"] = f"""WITH RECURSIVE {GAE},
g2 AS (SELECT *, v + CAST(event_id % 7 - 3 AS DOUBLE) / 10 AS v_new, exp(logp_new - logp_old) AS w, logp_new - logp_old AS lr FROM g),
terms AS (SELECT *, greatest(-least(greatest(w, 0.8), 1.2) * advantage, -w * advantage) AS surr, (w - 1.0) - lr AS kl,
             ret - (v + least(greatest(v_new - v, -0.2), 0.2)) AS ec, ret - v_new AS eu FROM g2),
hub AS (SELECT *,
   (CASE WHEN abs(ec) <= 10.0 THEN 1.0 ELSE 0.0 END) * ec * ec / 2 + (CASE WHEN ec > 10.0 THEN 1.0 ELSE 0.0 END) * 10.0 * (abs(ec) - 5.0) AS lc,
   (CASE WHEN abs(eu) <= 10.0 THEN 1.0 ELSE 0.0 END) * eu * eu / 2 + (CASE WHEN eu > 10.0 THEN 1.0 ELSE 0.0 END) * 10.0 * (abs(eu) - 5.0) AS lu
   FROM terms)
SELECT traj_id, round(avg(surr) - 0.01 * avg(entropy), 6) AS policy_loss, round(avg(entropy), 6) AS entropy,
       round(avg(kl), 6) AS approx_kl, avg(kl) > 0.02 AS kl_stop, round(avg(greatest(lc, lu)) * 1.0, 6) AS value_loss
FROM hub GROUP BY traj_id"""

Q["episode_summary"] = f"""WITH {TRAJ}
SELECT traj_id, round(avg(round(reward * 100)) / 100.0e0, 6) AS mean_step_reward,
       round(avg(CASE WHEN done THEN round(reward * 100) END) / 100.0e0, 6) AS mean_episode_return
FROM trajectories GROUP BY traj_id"""


def r6(x: str) -> str:
    """Round to 6 decimals exactly as the Spark side does (scale by 1e6, round half away from
    zero, scale back; negative zero becomes zero)."""
    return f"(CASE WHEN round(({x}) * 1e6) = 0 THEN 0.0e0 ELSE round(({x}) * 1e6) / 1e6 END)"


def _rewrite_round6(sql: str) -> str:
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + 6])
            i = j + 6
            continue
        depth, k = 1, j + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[k], 0)
            k += 1
        inner = sql[j + 6 : k - 1]
        if inner.endswith(", 6"):
            out.append(sql[i:j] + r6(_rewrite_round6(inner[:-3])))
        else:
            out.append(sql[i:k])
        i = k


def oracle_sql() -> dict[str, str]:
    return {k: _rewrite_round6(v) for k, v in Q.items()}


# ============================================================================= loans, prompts, steps

def lit(s: str) -> str:
    """A Python string as a DuckDB expression (quotes doubled, newlines as chr(10))."""
    parts = s.split("\n")
    q = [("'" + p.replace("'", "''") + "'") for p in parts]
    return "(" + " || chr(10) || ".join(q) + ")"


LOANS = """
loans AS (
  SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id,
    l_quantity * 10 AS installment, p_brand AS purpose, l_linestatus AS application_type,
    CAST(round(l_discount * 100) AS DOUBLE) AS int_rate, CAST(round(l_tax * 1000) AS DOUBLE) AS last_pymnt_amnt,
    l_extendedprice AS loan_amnt, o_totalprice AS revol_bal, CAST(l_linenumber - 1 AS DOUBLE) AS delinq_2yrs,
    CAST(l_partkey % 7 AS DOUBLE) AS inq_last_6mths, CAST(c_nationkey % 4 AS DOUBLE) AS mort_acc,
    substr(o_orderpriority, 1, 1) AS grade, CAST(p_size AS DOUBLE) AS open_acc, CAST(l_partkey % 1000 AS DOUBLE) / 10 AS revol_util,
    l_quantity AS total_acc, CAST(600 + l_suppkey % 200 AS DOUBLE) AS fico_range_low, CAST(604 + l_suppkey % 200 AS DOUBLE) AS fico_range_high,
    n_name AS addr_state, CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(p_size % 10 AS VARCHAR) || ' years' END AS emp_length,
    c_mktsegment AS home_ownership, o_orderstatus AS verification_status, CAST(round(c_acctbal * 100) AS DOUBLE) / 10 AS annual_inc,
    CASE l_returnflag WHEN 'A' THEN 'Fully Paid' WHEN 'R' THEN 'Charged Off' ELSE 'Current' END AS loan_status
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
final AS (SELECT * FROM loans WHERE loan_status IN ('Fully Paid', 'Charged Off'))"""

RAW = ["installment", "purpose", "application_type", "int_rate", "last_pymnt_amnt", "loan_amnt", "revol_bal",
       "delinq_2yrs", "inq_last_6mths", "mort_acc", "grade", "open_acc", "revol_util", "total_acc",
       "fico_range_low", "fico_range_high", "addr_state", "emp_length", "home_ownership", "verification_status",
       "annual_inc", "loan_status"]
DISPLAY = ["Installment", "Loan Purpose", "Loan Application Type", "Interest Rate", "Last Payment Amount",
           "Loan Amount", "Revolving Balance", "Delinquency In 2 years", "Inquiries In 6 Months", "Mortgage Accounts",
           "Grade", "Open Accounts", "Revolving Utilization Rate", "Total Accounts", "Fico Range Low", "Fico Range High",
           "Address State", "Employment Length", "Home Ownership", "Verification Status", "Annual Income", "Loan Status"]
DISPLAY_SELECT = ", ".join(f'{r} AS "{d}"' for r, d in zip(RAW, DISPLAY))
FEATURES = f"""{LOANS},
features AS (SELECT id, {DISPLAY_SELECT} FROM final WHERE COLUMNS(*) IS NOT NULL)"""

SPLIT = f"""{LOANS},
r_split AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':10086'), id) - 1 AS rk, count(*) OVER () AS n FROM final),
split AS (SELECT id, CASE WHEN rk < floor(n * 0.7e0) THEN 'train' WHEN rk < floor(n * 0.7e0) + floor(n * 0.1e0) THEN 'dev' ELSE 'test' END AS split FROM r_split)"""

Q["loan_features"] = f"""WITH {FEATURES} SELECT * FROM features"""

Q["loan_split"] = f"""WITH {SPLIT} SELECT id, split FROM split"""

Q["loan_stratified"] = f"""WITH {LOANS},
r AS (SELECT id, loan_status, row_number() OVER (PARTITION BY loan_status ORDER BY md5(id || ':10086'), id) - 1 AS rk,
             count(*) OVER (PARTITION BY loan_status) AS n FROM loans)
SELECT id, loan_status FROM r WHERE rk < round(n * 0.01e0)"""

Q["loan_balanced_test"] = f"""WITH {SPLIT},
s AS (SELECT id, loan_status FROM final JOIN split USING (id) WHERE split = 'test'),
k AS (SELECT count(*) AS k FROM s WHERE loan_status = 'Charged Off'),
neg AS (SELECT id, loan_status, row_number() OVER (ORDER BY md5(id || ':10086'), id) - 1 AS rk FROM s WHERE loan_status <> 'Charged Off')
SELECT id, loan_status FROM s WHERE loan_status = 'Charged Off'
UNION ALL
SELECT id, loan_status FROM neg, k WHERE rk < k.k"""

Q["loan_holdout_modes"] = f"""WITH {LOANS},
r AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rk, row_number() OVER (ORDER BY md5(id || ':10086'), id) - 1 AS mk, count(*) OVER () AS n FROM final)
SELECT id, 'last_n' AS mode, CASE WHEN rk >= n - 100 THEN 'eval' ELSE 'train' END AS split FROM r
UNION ALL
SELECT id, 'fraction', CASE WHEN CAST('0x' || substr(md5(id || ':10086'), 1, 8) AS BIGINT) / 4294967296.0e0 < 0.1e0 THEN 'eval' ELSE 'train' END FROM final
UNION ALL
SELECT id, 'overlap', 'train' FROM final
UNION ALL
SELECT id, 'overlap', 'eval' FROM r WHERE mk < 100"""

Q["loan_undersample"] = f"""WITH {LOANS},
r AS (SELECT id, loan_status, row_number() OVER (PARTITION BY loan_status ORDER BY md5(id || ':10086'), id) - 1 AS rk FROM loans),
m AS (SELECT min(n) AS m FROM (SELECT count(*) AS n FROM loans GROUP BY loan_status))
SELECT id, loan_status FROM r, m WHERE rk < m.m"""

Q["loan_few_shot"] = f"""WITH {SPLIT}
SELECT id FROM split WHERE split = 'train' ORDER BY md5(id || ':10086') LIMIT 8"""

Q["loan_holdout"] = f"""WITH {LOANS},
r AS (SELECT id, row_number() OVER (ORDER BY md5(id || ':10086'), id) - 1 AS rk, count(*) OVER () AS n FROM final)
SELECT id, CASE WHEN rk < ceil(n * 0.1e0) THEN 'eval' ELSE 'train' END AS split FROM r"""

Q["loan_set_ops"] = f"""WITH {SPLIT}
SELECT id, loan_status, CASE WHEN split = 'train' THEN 'train' ELSE 'test' END AS side FROM final JOIN split USING (id)"""

Q["event_batches"] = """WITH
a AS (SELECT event_id, CAST(floor((row_number() OVER (ORDER BY event_id) - 1) / 64) AS BIGINT) AS batch_contiguous FROM events),
r AS (SELECT event_id, row_number() OVER (ORDER BY md5(CAST(event_id AS VARCHAR) || ':10086'), event_id) - 1 AS rk, count(*) OVER () AS n FROM events),
b AS (SELECT event_id, CAST(floor(rk / 64) AS BIGINT) AS batch_shuffled FROM r WHERE rk < floor(n / 64) * 64)
SELECT event_id, batch_contiguous, batch_shuffled FROM a LEFT JOIN b USING (event_id)"""

Q["order_parts"] = """WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS rk, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CAST(floor(rk / ceil(n / 7)) + 1 AS INTEGER) AS part_even, CAST(floor(rk / 1000) + 1 AS INTEGER) AS part_chunk FROM r"""

Q["replicated_prompts"] = """SELECT o_orderkey, CAST(g AS INTEGER) AS gen, CAST(floor(g / 4) AS INTEGER) AS batch FROM orders, range(10) t(g)"""

_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_SPELL = """c AS (SELECT * FROM (VALUES (0, 'lower'), (1, 'capitalized'), (2, 'upper')) t(ci, c)),
l AS (SELECT * FROM (VALUES (0, ''), (1, ' '), (2, '  ')) t(li, l)),
t AS (SELECT * FROM (VALUES (0, ''), (1, ' '), (2, '  ')) t(ti, t)),
v AS (SELECT word, CAST(9 * li + 3 * ci + ti AS INTEGER) AS number,
  l || CASE c WHEN 'lower' THEN lower(word) WHEN 'capitalized' THEN upper(substr(word, 1, 1)) || lower(substr(word, 2)) ELSE upper(word) END || t AS variant
FROM w, c, l, t)"""

Q["verdict_spellings"] = f"""WITH {ANSWERS},
w AS (SELECT DISTINCT expected AS word FROM answers), {_SPELL}
SELECT word, number, variant FROM v"""

Q["verdict_tokens"] = f"""WITH {ANSWERS},
w AS (SELECT * FROM (VALUES ('good'), ('bad')) t(word)), {_SPELL},
a AS (SELECT {_KEY}, regexp_extract(response, '(?i)assessment\\**:([^\\n]*)', 1) AS token FROM answers)
SELECT {_KEY}, token, x.word AS verdict_word, x.number AS variant_number, g.variant AS good_token, b.variant AS bad_token
FROM a LEFT JOIN v x ON x.variant = token LEFT JOIN v g ON g.word = 'good' AND g.number = x.number LEFT JOIN v b ON b.word = 'bad' AND b.number = x.number"""

_CATS = ["Loan Purpose", "Loan Application Type", "Grade", "Address State", "Employment Length", "Home Ownership", "Verification Status"]
Q["loan_cardinality"] = f"""WITH {LOANS}, d AS (SELECT {DISPLAY_SELECT} FROM final)
""" + "\nUNION ALL\n".join(f"""SELECT '{c}' AS "column", CAST(count(DISTINCT "{c}") AS BIGINT) AS n_distinct FROM d""" for c in _CATS)

Q["loan_label_map"] = f"""WITH {LOANS}, d AS (SELECT {DISPLAY_SELECT} FROM final)
""" + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", v AS value, CAST(row_number() OVER (ORDER BY v NULLS LAST) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT "{c}" AS v FROM d)"""
    for c in _CATS)

_ONE_HOT = {
    "Loan Application Type": ["F", "O"], "Grade": [str(i) for i in range(1, 6)], "Employment Length": [f"{i} years" for i in range(10)],
    "Home Ownership": ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "Verification Status": ["F", "O", "P"],
}  # the values of the columns with at most 20
_PLAIN = [d for d in DISPLAY if d not in _CATS and d != "Loan Status"]
Q["loan_encoded"] = f"""WITH {SPLIT},
d AS (SELECT id, {DISPLAY_SELECT}, split FROM final JOIN split USING (id) WHERE split IN ('train', 'test')),
mp AS (SELECT v, row_number() OVER (ORDER BY v NULLS LAST) - 1 AS code FROM (SELECT DISTINCT "Loan Purpose" AS v FROM d)),
ms AS (SELECT v, row_number() OVER (ORDER BY v NULLS LAST) - 1 AS code FROM (SELECT DISTINCT "Address State" AS v FROM d))
SELECT id, CASE WHEN "Loan Status" = 'Fully Paid' THEN 0 ELSE 1 END AS "Loan Status",
  CAST(mp.code AS INTEGER) AS "Loan Purpose", CAST(ms.code AS INTEGER) AS "Address State", {", ".join(f'"{c}"' for c in _PLAIN)},
  {", ".join(f"""CASE WHEN "{c}" = '{v}' THEN 1 ELSE 0 END AS "{c}_{v}\"""" for c, vs in _ONE_HOT.items() for v in vs)},
  split AS side
FROM d JOIN mp ON d."Loan Purpose" IS NOT DISTINCT FROM mp.v JOIN ms ON d."Address State" IS NOT DISTINCT FROM ms.v"""

_NUMERIC = [r for r, d in zip(RAW, DISPLAY) if d in _PLAIN]
Q["loan_standardized"] = f"""WITH {LOANS},
st AS (SELECT {", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in _NUMERIC)} FROM final)
SELECT id, {", ".join(f"round(({c} - m_{c}) / nullif(s_{c}, 0), 6) AS {c}_z" for c in _NUMERIC)} FROM final, st"""


def _v(name: str, typ: str) -> str:
    return f"""coalesce(CAST("{name}" AS VARCHAR), 'None')"""


_DTYPE = {d: ("s" if r in ("purpose", "application_type", "grade", "addr_state", "emp_length", "home_ownership", "verification_status", "loan_status") else "d") for r, d in zip(RAW, DISPLAY)}
_FEATS = DISPLAY[:-1]


def _prior_text() -> str:
    parts = []
    for i, f in enumerate(_FEATS):
        pct = "%" if i in (3, 12) else ""
        sep = "." if i == len(_FEATS) - 1 else ". "
        parts.append(f"{lit('The ' + f + ' is ')} || {_v(f, _DTYPE[f])} || {lit(pct + sep)}")
    return lit("The client has attributes as follows: ") + " || " + " || ".join(parts)


PRIOR_INSTRUCTION = (
    "Assess the client's loan status based on the following loan records from Lending Club. "
    "Respond with only 'good' or 'bad', and do not provide any additional information. For instance, "
    "'The client has a stable income, no previous debts, and owns a property.' "
    "should be classified as 'good'. \nText: "
)

Q["prior_prompts"] = f"""WITH {FEATURES},
t AS (SELECT *, {_prior_text()} AS text FROM features)
SELECT id, text, {lit(PRIOR_INSTRUCTION + "'")} || text || {lit("' " + chr(10) + "Answer:")} AS query,
  CASE WHEN "Loan Status" = 'Fully Paid' THEN 'good' ELSE 'bad' END AS answer,
  CASE WHEN "Loan Status" = 'Fully Paid' THEN 0 ELSE 1 END AS gold,
  'good,bad' AS choices,
  CASE WHEN "Loan Status" = 'Fully Paid' THEN 'good' ELSE 'bad' END AS label_word
FROM t"""


def _post_text() -> str:
    parts = []
    for f in _FEATS:
        if f in ("Interest Rate", "Revolving Utilization Rate"):
            v = f"""printf('%.2f', "{f}") || '%'"""
        else:
            v = _v(f, _DTYPE[f])
        parts.append(f"{lit('The ' + f + ' is ')} || {v} || '. '")
    return " || ".join(parts)


_REF = "As reference, the predicted probability of this client's loan status being good given by the machine learning model Random Forest is "
POSTERIOR = f"""{FEATURES},
pp AS (SELECT *, CAST((CAST("Fico Range Low" AS INTEGER) * 7 + CAST("Open Accounts" AS INTEGER) * 13) % 1000 AS BIGINT) AS k FROM features),
pq AS (SELECT id, {_post_text()} AS text,
         {lit(_REF)} || printf('%.2f', (CAST(1000 - k AS DOUBLE) / 1000) * 100) || {lit("%, and the probability of it being bad is ")}
           || printf('%.2f', (CAST(k AS DOUBLE) / 1000) * 100) || {lit("%. " + chr(10) + "Answer:")} AS ref FROM pp),
post AS (SELECT id, text, {lit(PRIOR_INSTRUCTION)} || text || ref AS query, 'Text: ' || text || ref AS query_cot FROM pq)"""

Q["posterior_prompts"] = f"""WITH {POSTERIOR} SELECT id, text, query, query_cot FROM post"""

_INTRO = "Here is the customer's credit report:\n"
_COT_INSTR = "Please analyse the credit report step by step.\n" + _INTRO
_COT_EXPL = "Feature notes: rates are in percent.\n"
Q["cot_messages"] = f"""WITH {POSTERIOR},
c AS (SELECT id, {lit(_COT_INSTR.replace(_INTRO, '') + _COT_EXPL + _INTRO)} || query_cot AS prompt FROM post)
SELECT id, md5(prompt) AS prompt_md5, 2 AS n_messages, 'system' AS first_role, md5(prompt) AS user_md5 FROM c"""

Q["conversation_records"] = """WITH
o AS (SELECT conv_id, list(struct_pack("from" := role, value := text) ORDER BY turn) AS conv FROM conversations GROUP BY conv_id),
t AS (SELECT conv_id, CASE WHEN conv[1]."from" <> 'user' THEN conv[2:] ELSE conv END AS conv FROM o)
SELECT conv_id, len(conv) AS n_turns, conv[1]."from" AS first_from,
  array_to_string(list_transform(conv, lambda x: CASE WHEN x."from" = 'assistant' THEN len(regexp_split_to_array(x.value, '\\s+')) ELSE -100 END), ',') AS turn_mask
FROM t"""

_WSRE = "[ \\t\\n\\r\\f\\v]+"
Q["doc_steps"] = f"""WITH d AS (SELECT doc_id, text, strpos(text, chr(10) || 'Answer:' || chr(10)) AS p FROM documents),
e AS (SELECT *, string_split(text, chr(10))[1] || '.' || chr(10) || chr(10) AS t0 FROM d)
SELECT doc_id, len(string_split(text, chr(10))) AS n_steps,
  len(list_filter(regexp_split_to_array({strip('text')}, '{_WSRE}'), lambda w: w <> '')) AS n_words,
  md5(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))) AS joined_md5,
  md5(t0) AS tagged_md5,
  md5(replace(text || chr(10), chr(10), 'ки')) AS marked_md5,
  CASE WHEN p > 0 THEN p - 1 ELSE length(text) END AS obs_head_len,
  CASE WHEN p > 0 THEN length(text) - p - 8 ELSE 0 END AS obs_tail_len
FROM e"""

_ENDINGS = [chr(10) + "   " + chr(10), chr(10) + "  " + chr(10), chr(10) + " " + chr(10), chr(10) * 2, "." + chr(10) * 2, ":" + chr(10) * 2, " " + chr(10) * 2]


def _tagged(x: str) -> str:
    cases = " ".join(f"WHEN ends_with({x}, {lit(e)}) THEN replace({x}, {lit(e)}, chr(10) || chr(10))" for e in _ENDINGS)
    return f"CASE {cases} ELSE {x} || chr(10) || chr(10) END"


Q["doc_step_tags"] = f"""WITH d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n(?: *\\n)*|[^\\n]+') AS steps FROM documents)
SELECT doc_id, len(steps) AS n_steps, md5({_tagged('text')}) AS tagged_md5,
  md5(array_to_string(list_transform(steps, lambda x: {_tagged('x')}), '')) AS step_tagged_md5
FROM d"""


# ============================================================================= process-reward, token arrays

_RN = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1"
TREE = f"""
ro AS (SELECT l_orderkey AS question_id, CAST(floor(({_RN}) / 2) AS BIGINT) AS node_id, CAST({_RN} AS INTEGER) AS pos,
              'Check part ' || l_partkey || ' from supplier ' || l_suppkey || '.' AS rollout, l_returnflag = 'R' AS correct FROM lineitem),
nodes AS (SELECT question_id, node_id, CASE WHEN node_id = 0 THEN NULL ELSE CAST(floor((node_id - 1) / 2) AS BIGINT) END AS parent_id,
                 node_id AS seq, 'Step ' || node_id || ': ' || min(rollout) AS text, count(*) AS visits FROM ro GROUP BY question_id, node_id),
mc AS (SELECT question_id, node_id, count(*) AS total_rollouts, sum(CAST(correct AS INTEGER)) AS correct_rollouts,
              coalesce(CAST(sum(CAST(correct AS INTEGER)) AS DOUBLE) / nullif(count(*), 0), 0.0) AS mc FROM ro GROUP BY question_id, node_id),
p(question_id, node_id, path, up) AS (
  SELECT question_id, node_id, text, parent_id FROM nodes
  UNION ALL
  SELECT p.question_id, p.node_id, n.text || chr(10) || chr(10) || p.path, n.parent_id
  FROM p JOIN nodes n ON n.question_id = p.question_id AND n.node_id = p.up),
tree AS (SELECT n.*, p.path AS prefix, mc.mc FROM nodes n JOIN p ON n.question_id = p.question_id AND n.node_id = p.node_id AND p.up IS NULL
         JOIN mc ON mc.question_id = n.question_id AND mc.node_id = n.node_id)"""

Q["question_mixed"] = f"""WITH {TREE}
SELECT question_id FROM ro GROUP BY question_id HAVING bool_or(correct) AND bool_or(NOT correct)"""

Q["node_mc"] = f"""WITH {TREE},
inc AS (SELECT question_id, node_id, count(*) AS n_incorrect FROM (SELECT DISTINCT question_id, node_id, rollout FROM ro WHERE NOT correct) GROUP BY ALL)
SELECT mc.question_id, mc.node_id, total_rollouts, correct_rollouts, round(mc, 6) AS mc,
  CASE WHEN mc = 1.0 THEN 'all_correct' WHEN mc = 0.0 THEN 'all_incorrect' ELSE 'mixed' END AS mc_class, coalesce(n_incorrect, 0) AS n_incorrect
FROM mc LEFT JOIN inc ON mc.question_id = inc.question_id AND mc.node_id = inc.node_id"""

Q["tree_export"] = f"""WITH RECURSIVE {TREE},
edges AS (SELECT c.question_id, c.node_id,
            md5({strip("CASE WHEN pp.prefix IS NULL THEN c.prefix WHEN starts_with(c.prefix, pp.prefix) THEN substr(c.prefix, length(pp.prefix) + 1) ELSE c.prefix END")}) AS edge_md5
          FROM tree c LEFT JOIN tree pp ON pp.question_id = c.question_id AND pp.node_id = c.parent_id),
flat AS (SELECT question_id, count(*) AS n_prefixes,
            md5(string_agg(prefix || '|' || CAST(CAST(round(mc * 1000) AS BIGINT) AS VARCHAR), '#' ORDER BY seq)) AS export_md5 FROM tree GROUP BY question_id)
SELECT t.question_id, t.node_id, md5(t.prefix) AS prefix_md5, edge_md5, n_prefixes, export_md5
FROM tree t JOIN edges e ON t.question_id = e.question_id AND t.node_id = e.node_id JOIN flat f ON f.question_id = t.question_id"""

Q["flattened_prefixes"] = f"""WITH RECURSIVE {TREE},
f AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) - 1 AS pos FROM tree)
SELECT question_id, CAST(pos AS INTEGER) AS pos, md5(prefix) AS prefix_md5, round(mc, 6) AS mc_value FROM f WHERE mc <= 0.125e0 OR mc >= 1.0e0"""

Q["expanded_children"] = f"""WITH RECURSIVE {TREE}
SELECT t.question_id, t.node_id AS parent_id, ro.pos,
  md5(CASE WHEN coalesce(length(t.prefix), 0) > 0 THEN {strip("t.prefix || chr(10) || chr(10) || ro.rollout")} ELSE ro.rollout END) AS prefix_md5, 1.0e0 AS mc
FROM tree t JOIN ro ON ro.question_id = t.question_id AND ro.node_id = t.node_id
WHERE ro.correct AND t.mc > 0 AND t.mc < 1"""

_WC = f"len(list_filter(regexp_split_to_array({strip('ro.rollout')}, '{_WSRE}'), lambda w: w <> ''))"
Q["next_selection"] = f"""WITH {TREE},
tot AS (SELECT question_id, sum(visits) AS nt FROM nodes GROUP BY question_id),
u AS (SELECT n.question_id, n.node_id, 0.125e0 * sqrt(CAST(CASE WHEN nt = 0 THEN 1 ELSE nt END AS DOUBLE)) / (1.0e0 + visits) AS u
      FROM nodes n JOIN tot USING (question_id)),
pool AS (SELECT ro.question_id, ro.node_id, ro.pos AS seq,
           pow(0.5e0, 1.0e0 - mc.mc) * pow(0.9e0, {_WC} / 500.0e0) + u.u AS score
         FROM ro JOIN mc ON mc.question_id = ro.question_id AND mc.node_id = ro.node_id
                 JOIN u ON u.question_id = ro.question_id AND u.node_id = ro.node_id WHERE NOT ro.correct),
r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, seq) AS rn FROM pool)
SELECT question_id, node_id, seq, round(score, 6) AS score FROM r WHERE rn = 1"""

Q["latest_pool"] = f"""WITH {TREE},
r AS (SELECT question_id, node_id, rollout, pos AS seq, pos * 10 AS priority,
             row_number() OVER (PARTITION BY question_id, node_id, rollout ORDER BY pos DESC) AS rn FROM ro)
SELECT question_id, node_id, rollout, seq, priority FROM r WHERE rn = 1"""

Q["first_error"] = f"""WITH {TREE}
SELECT question_id AS solution_id, min(CASE WHEN mc = 0.0 THEN node_id END) AS first_error_step FROM mc GROUP BY question_id"""

Q["budget_cut"] = f"""WITH {TREE},
c AS (SELECT question_id, pos, pos % 3 + 1 AS cost FROM ro),
s AS (SELECT *, sum(cost) OVER (PARTITION BY question_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS spent FROM c)
SELECT question_id, pos, cost FROM s WHERE spent <= 4"""

Q["step_dataset"] = f"""WITH
dp AS (SELECT doc_id, string_split(text, chr(10))[1] || chr(10) AS q, text, CAST(doc_id % 9 AS DOUBLE) / 8.0e0 AS mc_value FROM documents),
sel AS (SELECT *, replace(text, q, '') AS rs FROM dp WHERE mc_value <= 0.125e0 OR mc_value >= 1.0e0),
lab AS (SELECT doc_id, mc_value, len(string_split(rs, chr(10))) AS n,
           CASE WHEN mc_value <= 0.125e0 THEN 0 ELSE 1 END AS last_label,
           CASE WHEN suffix(rs, chr(10)) THEN rs ELSE rs || chr(10) END AS reasoning_steps FROM sel),
neg AS (SELECT * FROM lab WHERE mc_value <> 1.0e0),
pos AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id) - 1 AS rk FROM lab WHERE mc_value = 1.0e0),
need AS (SELECT count(*) // 2 AS k FROM pos),
res AS (SELECT doc_id, mc_value, n, last_label, reasoning_steps FROM neg
        UNION ALL SELECT doc_id, mc_value, n, last_label, reasoning_steps FROM pos, need WHERE rk < need.k)
SELECT doc_id, round(mc_value, 6) AS mc_value, n AS n_labels, last_label, len(string_split(reasoning_steps, chr(10))) AS n_parts,
       md5(reasoning_steps) AS steps_md5 FROM res"""

Q["hard_subset"] = f"""WITH {CANDIDATES},
d AS (SELECT prompt_id, pos, pred_label, label, CASE WHEN pred_label IS NULL OR pred_label = label THEN 1 ELSE 0 END AS _ok FROM candidates),
m AS (SELECT count(*) AS m FROM d WHERE _ok = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY _ok ORDER BY md5(CAST(prompt_id AS VARCHAR) || ':' || CAST(pos AS VARCHAR) || ':3'), prompt_id, pos) - 1 AS rk FROM d)
SELECT prompt_id, pos, _ok, CASE WHEN pred_label IS NOT NULL AND pred_label = label THEN 1 ELSE 0 END AS strict_ok FROM r, m WHERE rk < m.m"""

TOK = """
tk AS (SELECT vec_id, label % 2 AS label, embedding,
              list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 20) + 12 AS INTEGER)) AS tokens FROM embeddings)"""

Q["embedding_tokens"] = f"""WITH {TOK}
SELECT vec_id,
  array_to_string(CASE WHEN len(tokens) > 16 THEN tokens[-16:] ELSE tokens END, ',') AS left16,
  array_to_string(list_resize(tokens, 80, 12), ',') AS padded,
  least(len(tokens), 80) AS n_attended,
  array_to_string(list_filter(range(len(tokens)), lambda i: tokens[i + 1] = 11), ',') AS tag_positions,
  list_filter(range(len(tokens) - 1), lambda i: tokens[i + 1] = 11 AND tokens[i + 2] = 12)[1] AS first_pair,
  coalesce(list_max(list_filter(range(len(tokens)), lambda i: tokens[i + 1] <> 12)), -1) AS last_real,
  coalesce(nullif(list_position(tokens, 13), 0), len(tokens)) AS eos_kept,
  round(1.0e0 / (1.0e0 + exp(CAST(embedding[2] AS DOUBLE) - CAST(embedding[1] AS DOUBLE))), 6) AS p_first
FROM tk"""

Q["embedding_step_labels"] = f"""WITH {TOK},
t2 AS (SELECT *, list_filter(range(len(tokens)), lambda i: tokens[i + 1] = 11) AS tags FROM tk)
SELECT vec_id,
  array_to_string(list_transform(range(len(tokens)), lambda i: CASE WHEN tokens[i + 1] = 11 THEN
      CASE WHEN (vec_id + list_position(tags, i) - 1) % 2 = 1 THEN 100 ELSE 200 END ELSE -100 END), ',') AS labels,
  array_to_string(list_transform(tokens, lambda x: CASE WHEN x = 11 THEN 0 ELSE 1 END), ',') AS attention
FROM t2"""

Q["embedding_token_metrics"] = f"""WITH {TOK},
src AS (SELECT 1 AS g, label, 1.0e0 / (1.0e0 + exp(-CAST(embedding[2] AS DOUBLE) * 10)) AS prob FROM tk WHERE label IN (0, 1)),
{_curve('src', 'label', 'prob', 'g')},
b AS (SELECT -avg(CASE WHEN label = 1 THEN ln(least(greatest(prob, 1e-15), 1 - 1e-15)) ELSE ln(1 - least(greatest(prob, 1e-15), 1 - 1e-15)) END) AS log_loss,
             avg(CASE WHEN CAST(prob > 0.5 AS INTEGER) = label THEN 1.0e0 ELSE 0.0e0 END) AS accuracy FROM src)
SELECT round(log_loss, 6) AS log_loss, round(accuracy, 6) AS accuracy, round(coalesce(roc_auc, 0.0), 6) AS roc_auc FROM b, cm"""

TOKROWS = f"""{TOK},
tr AS (SELECT vec_id, label, coalesce(list_max(list_filter(range(len(tokens)), lambda i: tokens[i + 1] <> 12)), -1) AS last_pos,
              CAST(unnest(range(len(embedding))) AS INTEGER) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM tk)"""

Q["sequence_logprobs"] = f"""WITH {TOKROWS}
SELECT vec_id, round(sum(-abs(x)), 6) AS seq_logp, round(avg(x * x), 6) AS seq_entropy FROM tr WHERE pos <= last_pos GROUP BY vec_id"""

Q["grpo_token_loss"] = f"""WITH {TOKROWS},
t AS (SELECT vec_id, pos, (label * 2 - 1) * 0.5e0 AS adv, -abs(x) AS logp, -abs(x) - pos / 1000.0e0 AS ref,
             CAST(pos <= last_pos AS INTEGER) AS m, x * x AS ent FROM tr),
k AS (SELECT *, exp(ref - logp) - (ref - logp) - 1.0e0 AS kl, exp(logp - ref) AS w, logp - ref AS lr FROM t),
s AS (SELECT vec_id, sum(-(adv - 0.001e0 * kl) * m) / nullif(sum(m), 0) AS loss, sum(kl * m) / nullif(sum(m), 0) AS kls,
             sum(m) AS len, count(*) AS width FROM k GROUP BY vec_id),
g AS (SELECT avg(loss) AS loss, avg(kls) AS kl, avg(len) AS completion_length, avg(CASE WHEN len = width THEN 1.0e0 ELSE 0.0e0 END) AS clip_ratio FROM s),
pl AS (SELECT sum((greatest(-least(greatest(w, 0.8e0), 1.2e0) * adv, -w * adv) - 0.01e0 * ent) * m) / nullif(sum(m), 0) AS policy_loss,
              sum(ent * m) / nullif(sum(m), 0) AS entropy, sum(((w - 1.0e0) - lr) * m) / nullif(sum(m), 0) AS approx_kl FROM k)
SELECT round(loss, 6) AS loss, round(kl, 6) AS kl, round(completion_length, 6) AS completion_length, round(clip_ratio, 6) AS clip_ratio,
       round(policy_loss, 6) AS policy_loss, round(entropy, 6) AS entropy, round(approx_kl, 6) AS approx_kl, approx_kl > 0.02 AS kl_stop
FROM g, pl"""

Q["token_gae"] = f"""WITH RECURSIVE {TRAJ},
tok AS (SELECT t.traj_id, t.step, t.reward, t.done, CAST(g AS INTEGER) AS token, t.v + g / 100.0e0 AS v
        FROM trajectories t, range(CAST(t.event_id % 3 AS BIGINT) + 1) r(g)),
ix AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY step, token) - 1 AS p FROM tok),
j AS (SELECT a.*, b.v AS vn, b.step AS sn, max(a.p) OVER (PARTITION BY a.traj_id) AS last_p FROM ix a LEFT JOIN ix b ON a.traj_id = b.traj_id AND b.p = a.p + 1),
d AS (SELECT *, CASE WHEN sn IS NULL OR sn <> step THEN (reward + {G}e0 * coalesce(vn, 0.0e0) * (1.0e0 - CAST(done AS DOUBLE))) - v
                     ELSE coalesce(vn, 0.0e0) - v END AS delta,
                CASE WHEN sn IS NULL OR sn <> step THEN {_GL}e0 * (1.0e0 - CAST(done AS DOUBLE)) ELSE {LAM}e0 END AS coef FROM j),
rec AS (SELECT traj_id, p, delta AS adv FROM d WHERE p = last_p
        UNION ALL SELECT d.traj_id, d.p, d.delta + d.coef * rec.adv FROM d JOIN rec ON d.traj_id = rec.traj_id AND d.p = rec.p - 1)
SELECT d.traj_id, d.step, d.token, round(rec.adv, 6) AS advantage, round(d.v + rec.adv, 6) AS ret FROM d JOIN rec ON d.traj_id = rec.traj_id AND d.p = rec.p"""

Q["batch_normalized"] = f"""WITH RECURSIVE {GAE},
b AS (SELECT traj_id, step, advantage, CAST(floor((row_number() OVER (ORDER BY traj_id, step) - 1) / 32) AS BIGINT) AS batch FROM g),
st AS (SELECT batch, avg(advantage) AS m, stddev_samp(advantage) AS s FROM b GROUP BY batch)
SELECT traj_id, step, batch, round((advantage - m) / (s + 1e-8), 6) AS adv_norm FROM b JOIN st USING (batch)"""

Q["continuation"] = """SELECT l_orderkey, CASE WHEN bool_and(l_returnflag = 'R') THEN 0.0e0 ELSE 1.0e0 END AS mask FROM lineitem GROUP BY l_orderkey"""

Q["formula_accuracy"] = f"""WITH {LOANS},
s AS (SELECT CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS label,
             1 / (1 + exp(-(0.05e0 * int_rate - 0.01e0 * (fico_range_low - 650) + 0.2e0 * delinq_2yrs - 0.5e0))) AS score FROM final)
SELECT round(avg(CASE WHEN (CASE WHEN score > 0.5 THEN 1 ELSE 0 END) = label THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy, count(*) AS n FROM s"""

Q["episode_done"] = """WITH
e AS (SELECT conv_id AS traj_id, turn AS step,
             CASE WHEN turn % 4 = 3 THEN text || chr(10) || 'Final assessment: good' ELSE text END AS action FROM conversations),
w AS (SELECT traj_id, step,
             sum(length(action)) OVER (PARTITION BY traj_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum,
             lower(right(chr(10) || array_to_string(list(action) OVER (PARTITION BY traj_id ORDER BY step ROWS BETWEEN 29 PRECEDING AND CURRENT ROW), ''), 1000)) AS tail
      FROM e)
SELECT traj_id, step,
       (cum > 3000 AND (contains(tail, 'final assessment: good') OR contains(tail, 'final assessment: bad'))) OR step + 1 >= 30 AS done
FROM w"""

Q["prediction_records"] = f"""WITH {CANDIDATES}
SELECT prompt_id, pos, pred_label, label, round(good_prob, 6) AS good_prob, round(bad_prob, 6) AS bad_prob, o_orderpriority AS priority
FROM candidates JOIN orders ON prompt_id = o_orderkey"""

Q["nested_candidates"] = f"""WITH {CANDIDATES}
SELECT prompt_id, count(*) AS n, string_agg(CAST(pos AS VARCHAR) || ':' || coalesce(CAST(pred_label AS VARCHAR), 'miss'), ',' ORDER BY pos) AS cands
FROM candidates GROUP BY prompt_id"""

Q["clean_coerce"] = f"""WITH {LOANS}
SELECT id, loan_amnt AS "Loan Amount _USD_", TRY_CAST(grade AS DOUBLE) AS "_Grade_", TRY_CAST(emp_length AS DOUBLE) AS "Employment Length" FROM final"""

Q["shuffled_rewards"] = f"""WITH {ANSWERS}
SELECT {KEY}, md5(response) AS response, CASE WHEN contains(lower(response), expected) THEN 1.0e0 ELSE 0.0e0 END AS r_user FROM answers"""

Q["class_balance"] = f"""WITH {LOANS}
SELECT loan_status, count(*) AS n, round(avg(int_rate), 6) AS mean_int_rate FROM loans GROUP BY loan_status"""


# ============================================================================= user functions, streams, attributions, masks

Q["batch_scorer"] = f"""WITH {CANDIDATES}, s AS (SELECT prompt_id, pos, string_split(lower(response), 'final assessment')[-1] AS seg FROM candidates)
SELECT prompt_id, pos, {word_label('seg')} AS pred_label FROM s"""

Q["step_scorer"] = f"""WITH {CANDIDATES},
s AS (SELECT prompt_id, pos, list_transform(string_split(response, chr(10) || chr(10)), lambda x: (length(x) % 10) / 10.0e0) AS p FROM candidates)
SELECT prompt_id, pos, round(list_min(p), 6) AS score, round(p[-1], 6) AS last_reward FROM s"""

Q["stream_rewards"] = f"""WITH {REWARDS}
SELECT response AS completion, expected AS label, r_format, r_accuracy, r_risk, r_format + r_accuracy + r_risk AS reward FROM rw"""

_W = {"int_rate": 0.05, "fico_range_low": -0.01, "delinq_2yrs": 0.2, "revol_util": 0.015, "open_acc": -0.02}
Q["linear_attribution_fixed"] = f"""WITH {LOANS},
long AS ({" UNION ALL ".join(f"SELECT '{f}' AS feature, {w}e0 * ({f} - avg({f}) OVER ()) AS a FROM final" for f, w in _W.items())}),
imp AS (SELECT feature, avg(abs(a)) AS mean_abs FROM long GROUP BY feature),
ranked AS (SELECT feature, mean_abs, CAST(row_number() OVER (ORDER BY mean_abs DESC, feature) AS INTEGER) AS rank FROM imp),
dep AS (SELECT feature, count(*) AS n_points, round(max(a), 6) AS max_attr FROM long JOIN ranked USING (feature) WHERE rank = 1 GROUP BY feature)
SELECT feature, round(mean_abs, 6) AS mean_abs, rank, n_points, max_attr FROM ranked LEFT JOIN dep USING (feature)"""

Q["conversation_masks"] = """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
kept AS (SELECT *, regexp_split_to_array(text, '\\s+') AS w FROM t WHERE k > 1 OR role = 'user'),
given AS (SELECT conv_id, k, ['<|im_start|>', role, chr(10)] || w || ['<|im_end|>', chr(10)] AS a,
                 ['<|im_start|>', '-100', '-100'] || CASE WHEN role = 'assistant' THEN w ELSE list_transform(w, lambda x: '-100') END || ['<|im_end|>', chr(10)] AS b FROM kept),
head AS (SELECT ['<|im_start|>', 'system', chr(10), 'You', 'judge', 'credit', 'risk', '<|im_end|>', chr(10)] AS a,
                ['<|im_start|>', '-100', '-100', '-100', '-100', '-100', '-100', '<|im_end|>', chr(10)] AS b),
ids AS (SELECT DISTINCT conv_id FROM conversations),
rows AS (SELECT ids.conv_id, any_value(head.a) || coalesce(flatten(list(given.a ORDER BY k) FILTER (WHERE k IS NOT NULL)), []) AS a,
                any_value(head.b) || coalesce(flatten(list(given.b ORDER BY k) FILTER (WHERE k IS NOT NULL)), []) AS b
         FROM ids CROSS JOIN head LEFT JOIN given ON given.conv_id = ids.conv_id GROUP BY ids.conv_id)
SELECT conv_id, md5(array_to_string(list_resize(a, 2048, '<pad>'), '|')) AS input_md5, md5(array_to_string(list_resize(b, 2048, '-100'), '|')) AS target_md5 FROM rows"""

Q["conversation_masks_whole"] = """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
kept AS (SELECT *, regexp_split_to_array(text, '\\s+') AS w FROM t WHERE k > 1 OR role = 'user'),
given AS (SELECT conv_id, k, ['<|im_start|>', role, chr(10)] || w || ['<|im_end|>', chr(10)] AS a,
                 ['<|im_start|>', '-100', '-100'] || CASE WHEN role = 'assistant' THEN w ELSE list_transform(w, lambda x: '-100') END || ['<|im_end|>', chr(10)] AS b FROM kept),
head AS (SELECT ['<|im_start|>', 'system', chr(10), 'You', 'judge', 'credit', 'risk', '<|im_end|>', chr(10)] AS a,
                ['<|im_start|>', '-100', '-100', '-100', '-100', '-100', '-100', '<|im_end|>', chr(10)] AS b),
ids AS (SELECT DISTINCT conv_id FROM conversations),
rows AS (SELECT ids.conv_id, any_value(head.a) || coalesce(flatten(list(given.a ORDER BY k) FILTER (WHERE k IS NOT NULL)), []) AS a,
                any_value(head.b) || coalesce(flatten(list(given.b ORDER BY k) FILTER (WHERE k IS NOT NULL)), []) AS b
         FROM ids CROSS JOIN head LEFT JOIN given ON given.conv_id = ids.conv_id GROUP BY ids.conv_id)
SELECT conv_id, CAST(len(a) AS INTEGER) AS n_places, md5(array_to_string(a, '|')) AS input_md5, md5(array_to_string(b, '|')) AS target_md5 FROM rows"""

Q["step_pipeline"] = Q["step_dataset"]

Q["record_files"] = """WITH o AS (SELECT o_orderkey, o_custkey, substr(o_orderpriority, 1, 1) AS part, o_orderkey % 64 AS k FROM orders),
f AS (SELECT part, k, count(*) AS n, sum(o_custkey) AS c FROM o GROUP BY part, k)
SELECT 'lines' AS kind, part, CAST(count(*) FILTER (o_orderkey % 50 <> 0) AS BIGINT) AS records, CAST(count(*) FILTER (o_orderkey % 50 = 0) AS BIGINT) AS bad_records,
  CAST(sum(o_custkey) FILTER (o_orderkey % 50 <> 0) AS BIGINT) AS customers FROM o GROUP BY part
UNION ALL SELECT 'arrays.json', part, CAST(sum(n) FILTER (k % 16 <> 0) AS BIGINT), CAST(count(*) FILTER (k % 16 = 0) AS BIGINT), CAST(sum(c) FILTER (k % 16 <> 0) AS BIGINT) FROM f GROUP BY part"""

Q["append_retry"] = """SELECT o_orderstatus AS batch, o_orderpriority, count(*) AS n, count(DISTINCT o_orderkey) AS n_units FROM orders GROUP BY ALL"""

Q["loan_subset"] = f"""WITH {LOANS}, d AS (SELECT id, emp_length, {DISPLAY_SELECT} FROM final)
SELECT * EXCLUDE (emp_length, "Loan Status") FROM d WHERE emp_length IS NOT NULL"""

Q["attached_outputs"] = f"""WITH {CANDIDATES}
SELECT prompt_id, o_orderpriority, o_custkey, pos, pred_label, md5(response) AS response_md5 FROM candidates JOIN orders ON o_orderkey = prompt_id"""

# ============================================================================= models and explanations

_LABELLED = "CASE WHEN loan_status = 'Charged Off' THEN 1 ELSE 0 END AS label"

Q["loan_folds"] = f"""WITH {LOANS}
SELECT id, loan_status, CAST((row_number() OVER (PARTITION BY loan_status ORDER BY md5(id || ':10086'), id) - 1) % 3 AS INTEGER) AS fold FROM final"""

Q["bayes_probabilities"] = f"""WITH {SPLIT},
d AS (SELECT *, {_LABELLED} FROM final JOIN split USING (id)),
tr AS (SELECT * FROM d WHERE split = 'train'),
f AS (SELECT 1e-9 * greatest({", ".join(f"var_pop({c})" for c in _NUMERIC)}) AS more FROM tr),
m AS (SELECT label, count(*) / sum(count(*)) OVER () AS prior, {", ".join(f"avg({c}) AS m_{c}, var_pop({c}) AS v_{c}" for c in _NUMERIC)} FROM tr GROUP BY label),
l AS (SELECT d.id, d.label, m.label AS class, ln(prior) - 0.5e0 * ({" + ".join(f"ln(2 * pi() * (v_{c} + more)) + pow({c} - m_{c}, 2) / (v_{c} + more)" for c in _NUMERIC)}) AS ll
      FROM d, m, f WHERE d.split = 'test')
SELECT a.id, a.label, round(1 / (1 + exp(a.ll - b.ll)), 6) AS bad_prob FROM l a JOIN l b ON a.id = b.id AND a.class = 0 AND b.class = 1"""

Q["logistic_optimum"] = f"""SELECT CAST(c AS DOUBLE) AS c, penalty, feature, TRUE AS optimal
FROM (VALUES (0.01), (0.1), (0.3), (1), (10)) t(c), (VALUES ('l1'), ('l2')) u(penalty), (VALUES ('intercept'), {", ".join(f"('{c}')" for c in _NUMERIC)}) v(feature)
WHERE (SELECT count(*) FROM lineitem) > 0"""

Q["tree_attribution"] = f"""WITH {SPLIT},
features AS (SELECT id, {DISPLAY_SELECT} FROM final WHERE COLUMNS(*) IS NOT NULL)
SELECT id, TRUE AS sums FROM features JOIN split USING (id) WHERE split = 'test'"""

# the fixed forest, by the definition: a known feature decides, an unknown one weighs both sides by their rows
_FOREST = [
    (0, 5.0, (1, 700.0, (20, 0.5), (40, 0.1)), (2, 2.0, (0, 8.0, (10, 0.3), (20, 0.7)), (10, 0.9))),
    (1, 650.0, (25, 0.8), (2, 4.0, (50, 0.2), (0, 3.0, (5, 0.35), (20, 0.6)))),
]
_FOREST_COLUMNS = ["int_rate", "fico_range_low", "delinq_2yrs"]


def _rows_of(node: tuple) -> int:
    return node[0] if len(node) == 2 else _rows_of(node[2]) + _rows_of(node[3])


def _expected(node: tuple, known: frozenset) -> str:
    if len(node) == 2:
        return f"{node[1]}e0"
    feature, cut, left, right = node
    a, b = _expected(left, known), _expected(right, known)
    if feature in known:
        return f"(CASE WHEN {_FOREST_COLUMNS[feature]} <= {cut}e0 THEN {a} ELSE {b} END)"
    return f"(({a} * {_rows_of(left)} + {b} * {_rows_of(right)}) / {_rows_of(left) + _rows_of(right)}e0)"


def _shapley(feature: int) -> str:
    others = [f for f in range(3) if f != feature]
    terms = []
    for mask in range(4):
        known = frozenset(f for k, f in enumerate(others) if mask >> k & 1)
        weight = {0: "2", 1: "1", 2: "2"}[len(known)]  # of 6 orders
        for tree in _FOREST:
            terms.append(f"{weight} * ({_expected(tree, known | {feature})} - {_expected(tree, known)})")
    return f"({' + '.join(terms)}) / 6e0"


Q["tree_attribution_fixed"] = f"""WITH {LOANS}
""" + "\nUNION ALL\n".join(f"SELECT id, '{c}' AS feature, round({_shapley(i)}, 6) AS attribution FROM final" for i, c in enumerate(_FOREST_COLUMNS))

Q["formula_logits"] = f"""WITH {LOANS},
s AS (SELECT {_LABELLED}, 0.4e0 - 0.02e0 * int_rate + 0.01e0 * (fico_range_low - 700) AS l0, 0.05e0 * int_rate + 0.1e0 * delinq_2yrs - 0.3e0 AS l1 FROM final)
SELECT round(avg(CASE WHEN (l1 > l0) = (label = 1) THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy, count(*) AS n FROM s"""

Q["formula_rounded"] = f"""WITH {LOANS},
s AS (SELECT {_LABELLED}, round_even(0.25e0 * (int_rate - 4) + 0.5e0 * (delinq_2yrs - 2), 0) AS score FROM final)
SELECT round(avg(CASE WHEN score = label THEN 1.0e0 ELSE 0.0e0 END), 6) AS accuracy, count(*) AS n FROM s"""

_SURROGATE = ["int_rate", "delinq_2yrs"]


def _uniform(*parts: str) -> str:
    text = "concat_ws(':', id, s, " + ", ".join(parts) + ")"
    return f"((CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) + 0.5e0) / 281474976710656e0)"


def _draw(i: int) -> str:
    return f"sqrt(-2 * ln({_uniform(str(i), '0', quoted('a'))})) * cos(2 * pi() * {_uniform(str(i), '0', quoted('b'))})"


def quoted(x: str) -> str:
    return f"'{x}'"


# weighted normal equations with a ridge of 1 on both weights
_NORMAL = """n AS (SELECT id, sum(w) AS a, sum(w * z0) AS b, sum(w * z1) AS c, sum(w * z0 * z0) + 1 AS d, sum(w * z0 * z1) AS e, sum(w * z1 * z1) + 1 AS f,
  sum(w * y) AS p, sum(w * z0 * y) AS q, sum(w * z1 * y) AS r FROM smp GROUP BY id),
x AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM n),
k AS (SELECT *, (p * (d * f - e * e) - b * (q * f - e * r) + c * (q * e - d * r)) / det AS k0,
  (a * (q * f - e * r) - p * (b * f - e * c) + c * (b * r - q * c)) / det AS k1, (a * (d * r - q * e) - b * (b * r - q * c) + p * (b * e - d * c)) / det AS k2 FROM x)"""
_SCORE = "1 / (1 + exp(-(0.08e0 * v0 + 0.3e0 * v1 - 0.9e0)))"

Q["lime_fixed"] = f"""WITH {LOANS},
st AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(_SURROGATE))} FROM final),
e AS (SELECT id, s, {", ".join(f"({c} - m{i}) / s{i} AS o{i}, {c} AS x{i}, m{i}, s{i}" for i, c in enumerate(_SURROGATE))} FROM final, st, range(40) g(s)
      WHERE int_rate = 10 AND delinq_2yrs >= 5),
z AS (SELECT *, {", ".join(f"CASE WHEN s = 0 THEN o{i} ELSE {_draw(i)} END AS z{i}" for i in range(2))} FROM e),
v AS (SELECT *, {", ".join(f"CASE WHEN s = 0 THEN x{i} ELSE z{i} * s{i} + m{i} END AS v{i}" for i in range(2))} FROM z),
smp AS (SELECT id, z0, z1, {_SCORE} AS y, exp(-(pow(z0 - o0, 2) + pow(z1 - o1, 2)) / 2.25e0) AS w FROM v),
{_NORMAL}
SELECT id, 'intercept' AS feature, round(k0, 6) AS weight FROM k UNION ALL SELECT id, 'int_rate', round(k1, 6) FROM k UNION ALL SELECT id, 'delinq_2yrs', round(k2, 6) FROM k"""


def _bucket(c: str, i: int) -> str:
    return f"(CAST({c} > qa{i} AS INTEGER) + CAST({c} > qb{i} AS INTEGER) + CAST({c} > qc{i} AS INTEGER))"


def _pick(stat: str, i: int) -> str:
    return f"(CASE b{i} " + " ".join(f"WHEN {b} THEN {stat}{i}{b}" for b in range(4)) + " END)"


_BUCKETS = ", ".join(
    f"count(*) FILTER (b{i} <= {b}) / count(*) AS u{i}{b}, " + ", ".join(f"coalesce({fn}({c}) FILTER (b{i} = {b}), 0) AS {k}{i}{b}" for k, fn in (("m", "avg"), ("d", "stddev_pop"), ("l", "min"), ("h", "max")))
    for i, c in enumerate(_SURROGATE) for b in range(4)
)
Q["lime_quartiles"] = f"""WITH {LOANS},
cuts AS (SELECT {", ".join(f"quantile_disc({c}, {q}) AS q{k}{i}" for i, c in enumerate(_SURROGATE) for k, q in (("a", 0.25), ("b", 0.5), ("c", 0.75)))} FROM final),
t AS (SELECT id, int_rate, delinq_2yrs, {", ".join(f"{_bucket(c, i)} AS b{i}" for i, c in enumerate(_SURROGATE))} FROM final, cuts),
st AS (SELECT {_BUCKETS} FROM t),
e AS (SELECT id, s, int_rate AS x0, delinq_2yrs AS x1, b0 AS o0, b1 AS o1, st.* FROM t, st, range(40) g(s) WHERE int_rate = 10 AND delinq_2yrs >= 5),
u AS (SELECT *, {", ".join(f"{_uniform(str(i), '0', quoted('u'))} AS u{i}, {_draw(i)} AS n{i}" for i in range(2))} FROM e),
b AS (SELECT *, {", ".join(f"CASE WHEN s = 0 THEN o{i} WHEN u{i} <= u{i}0 THEN 0 WHEN u{i} <= u{i}1 THEN 1 WHEN u{i} <= u{i}2 THEN 2 ELSE 3 END AS b{i}" for i in range(2))} FROM u),
v AS (SELECT *, {", ".join(f"CASE WHEN s = 0 THEN x{i} ELSE least(greatest({_pick('m', i)} + {_pick('d', i)} * n{i}, {_pick('l', i)}), {_pick('h', i)}) END AS v{i}, CAST(b{i} = o{i} AS DOUBLE) AS z{i}" for i in range(2))} FROM b),
smp AS (SELECT id, z0, z1, {_SCORE} AS y, exp(-(2 - z0 - z1) / 2.25e0) AS w FROM v),
{_NORMAL},
one AS (SELECT id, abs(k1) >= abs(k2) AS first, a, p, CASE WHEN abs(k1) >= abs(k2) THEN b ELSE c END AS b, CASE WHEN abs(k1) >= abs(k2) THEN d ELSE f END AS d,
  CASE WHEN abs(k1) >= abs(k2) THEN q ELSE r END AS q FROM k)
SELECT id, 'intercept' AS feature, round((p * d - b * q) / (a * d - b * b), 6) AS weight FROM one
UNION ALL SELECT id, CASE WHEN first THEN 'int_rate' ELSE 'delinq_2yrs' END, round((a * q - b * p) / (a * d - b * b), 6) FROM one"""
