"""Prompts as string expressions over a row."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The wording of the prompts.
INTRO = "You are a content moderator for the Reddit community r/{sub}.\n\n"
RULES = "The community has the following rules:\n{rules}\n\n"
ASK_THIS = "Determine whether the following comment violates the community's rules or norms. "
ASK_ANY = "Determine whether a comment violates the community's rules or norms. "
ANSWER = "Answer with 'True' if the comment should be removed, or 'False' if it should stay."
ASK_BARE = "Determine whether a comment violates the community's rules or norms.\n\n"
ONE_WORD = (
    "Your ENTIRE response MUST be exactly one of these two words: True or False. "
    "True means remove the comment. False means keep the comment.\n\n"
    "Do NOT include any explanation, reasoning, formatting, markdown, punctuation, "
    "or any other text. Output only the single word."
)
HALF_REMOVED = (
    "IMPORTANT: In this evaluation set, roughly half of all comments end up being "
    "removed by human moderators. Calibrate your decisions to that base rate. If you "
    "find yourself almost never marking comments for removal, your threshold is too "
    "strict. Use a balanced ~50% threshold: if you think there is a reasonable chance "
    "(>50%) that this comment violates the rules or norms, mark it for removal.\n\n"
)
SIDE_OF_REMOVAL = (
    "IMPORTANT: Err on the side of removal. If a comment plausibly violates any rule "
    "or community norm, mark it for removal. Under-removal lets harmful or "
    "rule-violating content stay up, which damages the community more than occasional "
    "over-removal.\n\n"
)
REASON_FIRST = (
    "First, in 1-3 sentences, reason through which rules might apply and whether the "
    "comment actually violates them. Then on a final line, output your verdict in "
    "exactly this format:\n\nFINAL: True\nor\nFINAL: False\n\n"
    "True means remove the comment. False means keep the comment. The FINAL line must "
    "be the last line of your response and contain only one of those two exact strings."
)
VARIANTS = {
    "default": ASK_BARE + ONE_WORD,
    "base_rate": ASK_BARE + HALF_REMOVED + ONE_WORD,
    "aggressive": ASK_BARE + SIDE_OF_REMOVAL + ONE_WORD,
    "cot": ASK_BARE + REASON_FIRST,
}
CONTEXT = "Context (preceding comment):\n"
CONTEXT_IN_THREAD = "Context (preceding comment in thread):\n"


def fill(template: str, **values: Column) -> Column:
    """``{name}`` in a template replaced by columns; null counts as empty."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for n in values if (i := rest.find("{" + n + "}")) >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        end = rest.index("}", at)
        parts.append(F.coalesce(values[rest[at + 1 : end]], F.lit("")))
        rest = rest[end + 1 :]
    return F.concat(*parts)


def _filled(text: Column) -> Column:
    return F.coalesce(text != "", F.lit(False))


def system_prompt(sub: Column, rules: Column, this_comment: bool = True) -> Column:
    """Training wording (``the following comment``) or evaluation wording, where empty rules leave no block."""
    if this_comment:
        return fill(INTRO + RULES + ASK_THIS + ANSWER, sub=sub, rules=rules)
    block = F.when(_filled(rules), fill(RULES, rules=rules)).otherwise("")
    return F.concat(fill(INTRO, sub=sub), block, F.lit(ASK_ANY + ANSWER))


def system_prompt_variant(sub: Column, rules: Column, variant: str) -> Column:
    block = F.when(_filled(rules), fill(RULES, rules=rules)).otherwise("")
    return F.concat(fill(INTRO, sub=sub), block, F.lit(VARIANTS[variant]))


def user_message(body: Column, parent: Column) -> Column:
    """Context, if any, and comment."""
    return F.concat_ws(
        "\n\n",
        F.when(_filled(parent), F.concat(F.lit(CONTEXT_IN_THREAD), parent)),
        F.concat(F.lit("Comment:\n"), F.coalesce(body, F.lit(""))),
    )


def _metadata(title: Column, top: Column, age: Column, first: Column) -> Column:
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Post title: "), title),
        F.concat(F.lit("Comment type: "), F.when(top, "top-level comment").otherwise("reply")),
        F.concat(F.lit("Author account age: "), age),
        F.concat(F.lit("First-time poster in community: "), F.when(first, "yes").otherwise("no")),
    )


def age_in_words(days: Column) -> Column:
    """Years from 365 days, months from 30, days above 0, else unknown; halves go to the even digit."""
    return (
        F.when(days >= 365, F.format_string("%.1f years", F.bround(days / 365, 1)))
        .when(days >= 30, F.format_string("%.0f months", F.bround(days / 30)))
        .when(days > 0, F.format_string("%.0f days", F.bround(days)))
        .otherwise("unknown")
    )


def enriched_message(
    body: Column, parent: Column, title: Column, top: Column, days: Column, first: Column
) -> Column:
    """Metadata, context, comment."""
    named = F.coalesce(F.nullif(title, F.lit("")), F.lit("unknown"))
    return F.concat_ws(
        "\n\n",
        _metadata(named, top, age_in_words(days), first),
        F.when(_filled(parent), F.concat(F.lit(CONTEXT), parent)),
        F.concat(F.lit("Comment:\n"), F.coalesce(body, F.lit(""))),
    )


def enriched_message_api(
    body: Column, parent: Column, title: Column, top: Column, days: Column, first: Column
) -> Column:
    """Context, metadata, comment; whole days from 0, empty title where there is none."""
    age = F.when(days >= 0, F.concat(F.floor(days).cast("string"), F.lit(" days"))).otherwise("unknown")
    return F.concat_ws(
        "\n\n",
        F.when(_filled(parent), F.concat(F.lit(CONTEXT_IN_THREAD), parent)),
        _metadata(F.coalesce(title, F.lit("")), top, age, first),
        F.concat(F.lit("Comment:\n"), F.coalesce(body, F.lit(""))),
    )


def plain_prompt(sub: Column, rules: Column, body: Column, parent: Column, label: Column | None = None) -> Column:
    """Without chat roles; with the answer for training, ending at the question for inference."""
    context = F.when(_filled(parent), F.concat(F.lit("\nContext (preceding comment): "), parent)).otherwise("")
    text = F.concat(
        system_prompt(sub, rules), F.lit("\n"), context, F.lit("\nComment: "), F.coalesce(body, F.lit("")),
        F.lit("\n\nClassification:"),
    )
    return text if label is None else F.concat(text, F.lit(" "), label)


def pooled_context(sub: Column, rules: Column, fallback_sub: str, fallback_rules: str) -> tuple[Column, Column]:
    """The row's own community and rules, else the given ones."""
    return (
        F.coalesce(F.nullif(sub, F.lit("")), F.lit(fallback_sub)),
        F.coalesce(F.nullif(rules, F.lit("")), F.lit(fallback_rules)),
    )


def with_community(message: Column, sub: Column) -> Column:
    return F.concat(F.lit("Subreddit: r/"), sub, F.lit("\n\n"), message)


def chat(system: Column, user: Column, system_role: bool = True) -> Column:
    """Messages ``(role, content)``; one user message for models without a system role."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    if not system_role:
        return F.array(message("user", F.concat(system, F.lit("\n\n"), user)))
    return F.array(message("system", system), message("user", user))


def chat_text(
    messages: Column, make_template: Callable[[], Callable[[list[dict]], str]] | None = None
) -> Column:
    """The messages as one text with an open assistant turn.

    Without a template these are role and content blocks. ``make_template`` is
    called once in each task and gives a function from a list of messages
    (``role``, ``content``) to text, such as a tokenizer's own chat template.
    """
    if make_template is not None:

        @F.pandas_udf("string")
        def render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            template = make_template()
            for rows in batches:
                yield rows.map(lambda ms: template([dict(m) for m in json.loads(ms)]), na_action="ignore")

        return render(F.to_json(messages))
    turns = F.transform(messages, lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(turns, ""), F.lit("<|assistant|>\n"))


def prompt_and_completion(prompt: Column, label: Column, end: str | None = None) -> Column:
    """``(prompt, completion)`` for training on the completion only.

    After a chat prompt the completion is the answer and the model's ``end``
    sign; without chat roles, ``end`` null, it is the answer after a space.
    """
    answer = F.when(label == "removed", "True").otherwise("False")
    completion = F.concat(F.lit(" "), answer) if end is None else F.concat(answer, F.lit(end))
    return F.struct(prompt.alias("prompt"), completion.alias("completion"))
