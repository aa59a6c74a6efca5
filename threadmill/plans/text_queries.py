"""Text features over comments and documents (whole texts)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadmill.functions import text as T
from threadmill.plans import sqltext as S
from threadmill.plans.registry import query
from threadmill.runtime import read_table


def _demo(spark, sf, **cols):
    return read_table(spark, sf, "demo_sample").select("sample_id", *[c.alias(n) for n, c in cols.items()])




@query(f"""SELECT sample_id,
  coalesce(round(CAST({S.count('body', r'\p{Lu}')} AS DOUBLE) / nullif({S.count('body', r'\p{L}')}, 0), 4), 0.0) AS caps_ratio
FROM demo_sample""")
def text_caps_ratio(spark, sf):
    return _demo(spark, sf, caps_ratio=T.caps_ratio(F.col("body")))


@query(f"""SELECT sample_id,
  {S.big(f"CASE WHEN {S.blank('body')} THEN 0 ELSE length(body) - length(replace(body, '!', '')) END")} AS exclamation_count,
  {S.big(f"CASE WHEN {S.blank('body')} THEN 0 ELSE length(body) - length(replace(body, '?', '')) END")} AS question_count
FROM demo_sample""")
def text_sign_counts(spark, sf):
    return _demo(spark, sf, exclamation_count=T.sign_count(F.col("body"), "!"), question_count=T.sign_count(F.col("body"), "?"))


@query(f"""WITH w AS (SELECT sample_id, {S.bare_words('body')} AS ws FROM demo_sample)
SELECT sample_id, CASE WHEN coalesce(len(ws), 0) = 0 THEN 0.0 ELSE
  {S.half_up('CAST(list_sum(list_transform(ws, lambda x: length(x))) AS BIGINT)', 'len(ws)', 2)} END AS avg_word_length FROM w""")
def text_average_word_length(spark, sf):
    return _demo(spark, sf, avg_word_length=T.average_word_length(F.col("body")))


@query(f"""WITH w AS (SELECT sample_id, {S.bare_words('lower(body)')} AS ws FROM demo_sample)
SELECT sample_id, coalesce(round(CAST(len(list_distinct(ws)) AS DOUBLE) / nullif(len(ws), 0), 4), 0.0) AS unique_word_ratio
FROM w""")
def text_unique_word_ratio(spark, sf):
    return _demo(spark, sf, unique_word_ratio=T.unique_word_ratio(F.col("body")))


@query(f"""SELECT sample_id,
  {S.big(f"CASE WHEN {S.blank('body')} THEN 0 ELSE {S.count('body', '[.!?]+')} + 1 END")} AS sentence_count
FROM demo_sample""")
def text_sentence_count(spark, sf):
    return _demo(spark, sf, sentence_count=T.sentence_count(F.col("body")))




# Word by word, as the word border of the engine compared with knows ASCII only.
_PROFANE = "|".join(p.removeprefix(r"\b").removesuffix(r"\b") for p in T.PROFANITY if p.endswith(r"\b")).replace(r"\w", r"[\p{L}\p{N}_]")


@query(rf"""WITH t AS (SELECT sample_id, coalesce(len(list_filter(regexp_extract_all(lower(body), '[\p{{L}}\p{{N}}_]+'),
    lambda w: regexp_full_match(w, '{_PROFANE}'))), 0) + {S.count('lower(body)', rf'(?:^|[^\p{{L}}\p{{N}}_])kill[{S.SPACE}]+your')} AS n FROM demo_sample)
SELECT sample_id, CAST(n AS BIGINT) AS profanity_count, n > 0 AS has_profanity_signal FROM t""")
def text_profanity(spark, sf):
    return _demo(spark, sf, profanity_count=T.profanity_count(F.col("body")), has_profanity_signal=T.has_profanity(F.col("body")))


@query(f"""SELECT sample_id, {S.big(f'''CASE WHEN {S.blank('body')} THEN 1 ELSE
  len(list_filter(string_split(body, chr(10) || chr(10)), lambda p: regexp_matches(p, '[^{S.SPACE}]'))) END''')} AS paragraph_count
FROM demo_sample""")
def text_paragraph_count(spark, sf):
    return _demo(spark, sf, paragraph_count=T.paragraph_count(F.col("body")))


@query(f"""SELECT sample_id, coalesce(regexp_matches(body, '^[{S.SPACE}]*>'), false) AS starts_with_quote FROM demo_sample""")
def text_starts_with_quote(spark, sf):
    return _demo(spark, sf, starts_with_quote=T.starts_with_quote(F.col("body")))


@query(f"SELECT sample_id, {S.big(S.count('body', 'https?://'))} AS link_count FROM demo_sample")
def text_link_count(spark, sf):
    return _demo(spark, sf, link_count=T.link_count(F.col("body")))


@query(f"""SELECT sample_id, {S.big(S.words('body'))} AS word_count, {S.big("coalesce(length(body), 0)")} AS char_count,
  {S.big(S.words('parent_body'))} AS parent_word_count, coalesce(parent_body, '') <> '' AS has_parent_body FROM demo_sample""")
def text_sizes(spark, sf):
    p = F.col("parent_body")
    return _demo(
        spark, sf, word_count=T.word_count(F.col("body")), char_count=T.char_count(F.col("body")),
        parent_word_count=T.word_count(p), has_parent_body=F.coalesce(p, F.lit("")) != "",
    )


@query(r"""SELECT sample_id, coalesce(contains(body, 'http://') OR contains(body, 'https://'), false) AS has_url,
  coalesce(contains(body, '**') OR contains(body, '~~') OR contains(body, '^') OR contains(body, '> ') OR contains(body, '# '), false)
  AS has_markdown FROM demo_sample""")
def text_markup(spark, sf):
    return _demo(spark, sf, has_url=T.has_url(F.col("body")), has_markdown=T.has_markdown(F.col("body")))


@query("SELECT doc_id, substring(text, 1, 2048) AS head FROM documents")
def text_left_chars(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", T.left_chars(F.col("text")).alias("head"))


@query(rf"""SELECT sample_id, regexp_extract(body, '(?s)^[{S.SPACE}]*(?:[^{S.SPACE}]+(?:[{S.SPACE}]+|\z)){{0,64}}', 0) AS head FROM demo_sample""")
def text_left_words(spark, sf):
    return _demo(spark, sf, head=T.left_words(F.col("body"), 64))


@query(rf"""SELECT sample_id, regexp_extract(body, '^(?:[\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{0b}}\x{{85}}]*(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\p{{Z}}\x{{1c}}-\x{{1f}}\x{{0b}}\x{{85}}]+)){{0,12}}', 0) AS head,
  CASE WHEN body IS NULL THEN NULL ELSE {S.count('body', r'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{1c}-\x{1f}\x{0b}\x{85}]+')} > 12 END AS cut FROM demo_sample""")
def text_left_tokens(spark, sf):
    """Texts cut after 12 tokens of a tokenizer; where nothing is cut the white space at the end stays and is left out here."""
    head = T.left_tokens(F.col("body"), 12)
    got = _demo(spark, sf, head=head, body=F.col("body"))
    cut = F.col("head") != F.col("body")
    return got.select("sample_id", F.when(cut, F.col("head")).otherwise(F.regexp_replace("head", rf"[{T.SPACE}]+\z", "")).alias("head"), cut.alias("cut"))


@query(rf"""SELECT sample_id, regexp_extract(body, '(?s)^[{S.SPACE}]*(?:[^{S.SPACE}]+(?:[{S.SPACE}]+|\z)){{0,512}}', 0) AS head,
  regexp_extract(parent_body, '(?s)^[{S.SPACE}]*(?:[^{S.SPACE}]+(?:[{S.SPACE}]+|\z)){{0,256}}', 0) AS parent_head FROM demo_sample""")
def text_left_words_full(spark, sf):
    """text_left_words with the reference's 512 tokens, and 256 for parents as in training."""
    return _demo(spark, sf, head=T.left_words(F.col("body"), 512), parent_head=T.left_words(F.col("parent_body"), 256))


@query(f"""SELECT source, count(*) AS n_docs, {S.big(f"sum({S.words('text')})")} AS words,
  {S.big(f"sum({S.count('text', 'https?://')})")} AS links,
  {S.big("sum(coalesce(length(text) - length(replace(text, '!', '')), 0))")} AS exclamations
FROM documents GROUP BY source""")
def text_by_source(spark, sf):
    t = F.col("text")
    return read_table(spark, sf, "documents").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(T.word_count(t)).alias("words"), F.sum(T.link_count(t)).alias("links"),
        F.sum(T.sign_count(t, "!")).alias("exclamations"),
    )
