"""Prompts, answers and scorers."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import answers as A
from threadmill.functions import prompts as P
from threadmill.operators import evaluate, scoring
from threadmill.plans import sqltext as S
from threadmill.plans.registry import query
from threadmill.runtime import read_table

RULES_OF = "Be kind in {sub}.\nStay on topic."
_RULES = r"'Be kind in ' || s || '.' || chr(10) || 'Stay on topic.'"


def _rows(spark, sf):
    demo = read_table(spark, sf, "demo_sample")
    sub = F.lower(F.coalesce("subreddit", F.lit("")))
    first = F.coalesce(F.pmod(F.col("sample_id"), F.lit(3)) == 0, F.lit(False))
    return demo.withColumns({"s": sub, "rules": P.fill(RULES_OF, sub=sub), "author_is_first": first})


_BASE = f"""b AS (SELECT *, lower(coalesce(subreddit, '')) AS s, coalesce(sample_id % 3 = 0, false) AS first FROM demo_sample),
r AS (SELECT *, {_RULES} AS rules FROM b)"""


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _filled(template: str) -> str:
    return _q(template).replace("{sub}", "' || s || '").replace("{rules}", "' || rules || '")


@query(f"""WITH {_BASE} SELECT sample_id, {_filled(P.INTRO + P.RULES + P.ASK_THIS + P.ANSWER)} AS train_prompt,
  {_filled(P.INTRO + P.RULES + P.ASK_ANY + P.ANSWER)} AS eval_prompt, {_filled(P.INTRO + P.ASK_ANY + P.ANSWER)} AS bare_prompt FROM r""")
def prompt_system(spark, sf):
    s, rules = F.col("s"), F.col("rules")
    return _rows(spark, sf).select(
        "sample_id", P.system_prompt(s, rules).alias("train_prompt"), P.system_prompt(s, rules, False).alias("eval_prompt"),
        P.system_prompt(s, F.lit(""), False).alias("bare_prompt"),
    )


@query(f"""WITH {_BASE} SELECT DISTINCT s, {', '.join(f'md5({_filled(P.INTRO + P.RULES + v)}) AS {n}_md5' for n, v in P.VARIANTS.items())} FROM r""")
def prompt_variants(spark, sf):
    s, rules = F.col("s"), F.col("rules")
    cols = [F.md5(P.system_prompt_variant(s, rules, v)).alias(f"{v}_md5") for v in P.VARIANTS]
    return _rows(spark, sf).select("s", *cols).distinct()


_CTX = "CASE WHEN coalesce(parent_body, '') <> '' THEN {0} || parent_body || chr(10) || chr(10) ELSE '' END"
_COMMENT = "'Comment:' || chr(10) || coalesce(body, '')"


@query(f"WITH {_BASE} SELECT sample_id, {_CTX.format(_q(P.CONTEXT_IN_THREAD))} || {_COMMENT} AS message FROM r")
def prompt_user(spark, sf):
    return _rows(spark, sf).select("sample_id", P.user_message(F.col("body"), F.col("parent_body")).alias("message"))


def _meta(title: str, age: str) -> str:
    return f"""'Post title: ' || {title} || chr(10) || 'Comment type: ' || CASE WHEN is_top_level THEN 'top-level comment' ELSE 'reply' END
  || chr(10) || 'Author account age: ' || {age} || chr(10) || 'First-time poster in community: ' || CASE WHEN first THEN 'yes' ELSE 'no' END
  || chr(10) || chr(10)"""


@query(f"""WITH {_BASE} SELECT sample_id, {_CTX.format(_q(P.CONTEXT_IN_THREAD))} || {_meta("coalesce(post_title, '')",
  "CASE WHEN account_age_days >= 0 THEN CAST(CAST(floor(account_age_days) AS BIGINT) AS VARCHAR) || ' days' ELSE 'unknown' END")} || {_COMMENT} AS message FROM r""")
def prompt_enriched_api(spark, sf):
    cols = [F.col(c) for c in ("body", "parent_body", "post_title", "is_top_level", "account_age_days", "author_is_first")]
    return _rows(spark, sf).select("sample_id", P.enriched_message_api(*cols).alias("message"))


_AGE = """CASE WHEN account_age_days >= 365 THEN printf('%.1f years', account_age_days / 365) WHEN account_age_days >= 30
  THEN printf('%.0f months', account_age_days / 30) WHEN account_age_days > 0 THEN printf('%.0f days', account_age_days) ELSE 'unknown' END"""


@query(f"""WITH {_BASE} SELECT sample_id, {_meta("coalesce(nullif(post_title, ''), 'unknown')", _AGE)} || {_CTX.format(_q(P.CONTEXT))} || {_COMMENT} AS message FROM r""")
def prompt_enriched(spark, sf):
    cols = [F.col(c) for c in ("body", "parent_body", "post_title", "is_top_level", "account_age_days", "author_is_first")]
    return _rows(spark, sf).select("sample_id", P.enriched_message(*cols).alias("message"))


@query("""SELECT sample_id, CASE WHEN account_age_days >= 365 THEN 'years' WHEN account_age_days >= 30 THEN 'months'
  WHEN account_age_days > 0 THEN 'days' ELSE 'unknown' END AS unit FROM demo_sample""")
def prompt_age_units(spark, sf):
    unit = F.regexp_extract(P.age_in_words(F.col("account_age_days")), r"[a-z]+$", 0)
    return read_table(spark, sf, "demo_sample").select("sample_id", unit.alias("unit"))


@query(f"""WITH {_BASE}, p AS (SELECT sample_id, label, {_filled(P.INTRO + P.RULES + P.ASK_THIS + P.ANSWER)} || chr(10)
  || CASE WHEN coalesce(parent_body, '') <> '' THEN chr(10) || 'Context (preceding comment): ' || parent_body ELSE '' END
  || chr(10) || 'Comment: ' || coalesce(body, '') || chr(10) || chr(10) || 'Classification:' AS prompt FROM r)
SELECT sample_id, prompt, prompt || ' ' || CASE WHEN label = 'removed' THEN 'True' ELSE 'False' END AS text FROM p""")
def prompt_plain(spark, sf):
    label = F.when(F.col("label") == "removed", "True").otherwise("False")
    args = [F.col(c) for c in ("s", "rules", "body", "parent_body")]
    return _rows(spark, sf).select("sample_id", P.plain_prompt(*args).alias("prompt"), P.plain_prompt(*args, label).alias("text"))


@query(f"""WITH {_BASE} SELECT sample_id, 'Subreddit: r/' || coalesce(nullif(s, ''), 'all') || chr(10) || chr(10) || {_COMMENT} AS message,
  coalesce(nullif(rules, ''), 'none') AS rules FROM r""")
def prompt_pooled(spark, sf):
    sub, rules = P.pooled_context(F.col("s"), F.col("rules"), "all", "none")
    message = P.with_community(P.user_message(F.col("body"), F.lit("")), sub)
    return _rows(spark, sf).select("sample_id", message.alias("message"), rules.alias("rules"))


@query(f"""WITH {_BASE}, m AS (SELECT sample_id, {_filled(P.INTRO + P.ASK_ANY + P.ANSWER)} AS a, {_COMMENT} AS b FROM r)
SELECT sample_id, '<|system|>' || chr(10) || a || chr(10) || '<|user|>' || chr(10) || b || chr(10) || '<|assistant|>' || chr(10) AS chat,
  '<|user|>' || chr(10) || a || chr(10) || chr(10) || b || chr(10) || '<|assistant|>' || chr(10) AS one_turn FROM m""")
def prompt_chat(spark, sf):
    system = P.system_prompt(F.col("s"), F.lit(""), False)
    user = P.user_message(F.col("body"), F.lit(""))
    return _rows(spark, sf).select(
        "sample_id", P.chat_text(P.chat(system, user)).alias("chat"), P.chat_text(P.chat(system, user, False)).alias("one_turn")
    )


def _bracket_template():
    return lambda messages: "".join(f"[{m['role']}]{m['content']}[/]" for m in messages) + "[assistant]"


@query(f"""WITH {_BASE}, m AS (SELECT sample_id, label, {_filled(P.INTRO + P.ASK_ANY + P.ANSWER)} AS a, {_COMMENT} AS b FROM r)
SELECT sample_id, '[system]' || a || '[/][user]' || b || '[/][assistant]' AS prompt,
  CASE WHEN label = 'removed' THEN 'True' ELSE 'False' END || '</s>' AS completion FROM m""")
def prompt_completion(spark, sf):
    """Prompt by a template of one's own and completion with an end sign."""
    chat = P.chat(P.system_prompt(F.col("s"), F.lit(""), False), P.user_message(F.col("body"), F.lit("")))
    pair = P.prompt_and_completion(P.chat_text(chat, _bracket_template), F.col("label"), "</s>")
    return _rows(spark, sf).select("sample_id", pair.alias("x")).select("sample_id", "x.*")


@query(f"""WITH {_BASE} SELECT sample_id, {_filled(P.INTRO + P.RULES + P.ASK_THIS + P.ANSWER)} || chr(10)
  || CASE WHEN coalesce(parent_body, '') <> '' THEN chr(10) || 'Context (preceding comment): ' || parent_body ELSE '' END
  || chr(10) || 'Comment: ' || coalesce(body, '') || chr(10) || chr(10) || 'Classification:' AS prompt,
  CASE WHEN label = 'removed' THEN ' True' ELSE ' False' END AS completion FROM r""")
def prompt_plain_completion(spark, sf):
    plain = P.plain_prompt(*[F.col(c) for c in ("s", "rules", "body", "parent_body")])
    return _rows(spark, sf).select("sample_id", P.prompt_and_completion(plain, F.col("label")).alias("x")).select("sample_id", "x.*")


def _answers(spark, sf):
    """Bodies as if a model had written them, some with a verdict before or after."""
    demo = read_table(spark, sf, "demo_sample")
    kind, body = F.pmod("sample_id", F.lit(7)), F.coalesce("body", F.lit(""))
    raw = (
        F.when(kind == 0, F.lit("True"))
        .when(kind == 1, F.concat(F.lit(" false. "), body))
        .when(kind == 2, F.concat(body, F.lit("\nFINAL: **True**.")))
        .when(kind == 3, F.concat(F.lit("'False', because "), body))
        .when(kind == 4, F.concat(F.lit("It is true. "), F.substring(body, 1, 10)))
        .when(kind == 5, F.lit("ERROR: blocked"))
        .otherwise(body)
    )
    return demo.select("sample_id", raw.alias("raw"))


_RAW = r"""raw AS (SELECT sample_id, CASE sample_id % 7 WHEN 0 THEN 'True' WHEN 1 THEN ' false. ' || coalesce(body, '')
  WHEN 2 THEN coalesce(body, '') || chr(10) || 'FINAL: **True**.' WHEN 3 THEN '''False'', because ' || coalesce(body, '')
  WHEN 4 THEN 'It is true. ' || substring(coalesce(body, ''), 1, 10) WHEN 5 THEN 'ERROR: blocked' ELSE coalesce(body, '') END AS raw FROM demo_sample)"""
_ST = S.strip("raw")


def _fw(text: str) -> str:
    return f"regexp_extract({text}, '[^{S.SPACE}]+', 0)"



@query(f"""WITH {_RAW}, t AS (SELECT sample_id, {_ST} AS t FROM raw), w AS (SELECT *, trim({_fw('t')}, '.,!;:''"') AS w,
  substring(t, 1, 20) AS h FROM t)
SELECT sample_id, CASE WHEN w IN ('True', 'False') THEN w WHEN contains(h, 'True') THEN 'True' WHEN contains(h, 'False') THEN 'False'
  ELSE 'unparseable' END AS prediction FROM w""")
def answer_first_word(spark, sf):
    return _answers(spark, sf).select("sample_id", A.parse_first_word(F.col("raw")).alias("prediction"))


@query(f"""WITH {_RAW}, t AS (SELECT sample_id, lower({_ST}) AS t FROM raw)
SELECT sample_id, CASE WHEN starts_with(t, 'error:') OR starts_with(t, 'blocked:') THEN 'unparseable' WHEN starts_with(t, 'true') THEN 'True'
  WHEN starts_with(t, 'false') THEN 'False' ELSE 'unparseable' END AS prediction FROM t""")
def answer_prefix(spark, sf):
    return _answers(spark, sf).select("sample_id", A.parse_prefix(F.col("raw")).alias("prediction"))


@query(f"""WITH {_RAW}, t AS (SELECT sample_id, CASE WHEN contains(raw, 'FINAL:') THEN string_split(raw, 'FINAL:')[-1]
    WHEN contains(raw, 'Final:') THEN string_split(raw, 'Final:')[-1] WHEN contains(raw, 'final:') THEN string_split(raw, 'final:')[-1] END AS tail,
  translate(lower({_ST}), '*`"''.,!?:;', '') AS t FROM raw),
w AS (SELECT *, {_fw("translate(lower(tail), '*`\"''.,!?:;' || chr(10), '           ')")} AS a, {_fw('t')} AS f FROM t)
SELECT sample_id, CASE WHEN a IN ('true', 'false') THEN upper(a[1]) || a[2:] WHEN f IN ('true', 'false') THEN upper(f[1]) || f[2:]
  WHEN contains(t, 'true') AND NOT contains(t, 'false') THEN 'True' WHEN contains(t, 'false') AND NOT contains(t, 'true') THEN 'False' END AS prediction
FROM w""")
def answer_final(spark, sf):
    return _answers(spark, sf).select("sample_id", A.parse_final(F.col("raw")).alias("prediction"))


@query(f"""WITH {_RAW} SELECT sample_id, CASE WHEN {_ST} IN ('True', 'False') THEN {_ST} ELSE 'unparseable' END AS prediction FROM raw""")
def answer_exact(spark, sf):
    return _answers(spark, sf).select("sample_id", A.parse_exact(F.col("raw")).alias("prediction"))


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN -value / 100 END AS a, CASE WHEN event_id % 5 <> 0 THEN -(100 - value) / 100 END AS b FROM events)
SELECT event_id, round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN exp(a) / (exp(a) + exp(b)) WHEN a IS NOT NULL THEN exp(a)
  WHEN b IS NOT NULL THEN 1.0::DOUBLE - exp(b) END, 4) AS confidence FROM l""")
def answer_confidence(spark, sf):
    ev = read_table(spark, sf, "events")
    a = F.when(F.col("event_id") % 3 != 0, -F.col("value") / 100)
    b = F.when(F.col("event_id") % 5 != 0, -(F.lit(100) - F.col("value")) / 100)
    return ev.select("event_id", A.confidence(a, b).alias("confidence"))


@query(f"""WITH {_BASE}, p AS (SELECT sample_id, label, coalesce(subreddit, '') AS s, {_COMMENT} AS prompt FROM r),
a AS (SELECT s, label, CASE WHEN {S.words('prompt')} < 40 THEN 'True' ELSE 'False' END AS prediction FROM p)
{S.cells('s', source='a')}""")
def score_length_rule(spark, sf):
    """Prompts through the scorer interface, answers parsed, confusion by community."""
    rows = _rows(spark, sf).select(
        "sample_id", "label", F.coalesce("subreddit", F.lit("")).alias("s"), P.user_message(F.col("body"), F.lit("")).alias("prompt")
    )
    got = scoring.score_prompts(rows, scoring.length_rule(40), key="sample_id")
    parsed = got.select("sample_id", A.parse_prefix(F.coalesce("error", "raw")).alias("prediction"))
    return evaluate.confusion(rows.drop("prompt").join(parsed, "sample_id"), ["s"])


@query("""SELECT lower(subreddit) AS subreddit, string_agg(CAST(n AS VARCHAR) || '. ' || line, chr(10) ORDER BY n) AS rules_text FROM (
  SELECT subreddit, n, CASE n WHEN 1 THEN 'Be kind: to ' || lower(subreddit) WHEN 3 THEN 'Stay on topic' ELSE 'No spam' END AS line
  FROM community, (VALUES (1), (3), (4)) v(n)) GROUP BY 1""")
def rules_numbered(spark, sf):
    """Rules of each community, the second blank: left out, but counted."""
    from threadmill.operators.enrich import rules_text

    rule = lambda name, text: F.struct(name.alias("short_name"), text.alias("description"))
    sub = F.lower("subreddit")
    rules = read_table(spark, sf, "community").select(
        sub.alias("subreddit"),
        F.array(
            rule(F.lit("Be kind"), F.concat(F.lit("to "), sub)), rule(F.lit(" "), F.lit("")),
            rule(F.lit("Stay on topic "), F.lit("")), rule(F.lit(""), F.lit("No spam")),
        ).alias("rules"),
    )
    return rules_text(rules)


@query("SELECT subreddit, '- Be kind' || chr(10) || '- ' || subreddit AS rules_text FROM community")
def rules_bulleted(spark, sf):
    from threadmill.operators.enrich import bulleted

    rows = read_table(spark, sf, "community")
    return bulleted(rows.select("subreddit", F.array(F.lit("Be kind"), "subreddit").alias("rules")))
