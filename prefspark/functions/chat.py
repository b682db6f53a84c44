"""Messages and chat templates on ``array<struct<role,content>>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import fixed


def message(role, content: Column) -> Column:
    role = role if isinstance(role, Column) else F.lit(role)
    return F.struct(role.alias("role"), content.alias("content"))


def map_role(role: Column) -> Column:
    """``human`` speaks as user, everyone else as assistant."""
    return F.when(role == "human", "user").otherwise("assistant")


def map_roles(context: Column) -> Column:
    """Raw ``{role, text}`` turns to ``{role, content}`` messages."""
    return F.transform(context, lambda m: message(map_role(m["role"]), m["text"]))


def history_of(messages: Column) -> Column:
    return F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))


def response_of(messages: Column) -> Column:
    return F.element_at(messages, -1)


def tail_after(messages: Column, history: Column) -> Column:
    """What follows the shared history; may be several messages."""
    return F.slice(messages, F.size(history) + 1, F.size(messages))


def chatml_message(role: Column, content: Column, opens: Column, eos: str) -> Column:
    """One rendered message; a conversation is these texts in order.

    A message that opens the list and comes from the assistant gets no header.
    """
    body = F.concat(F.coalesce(content, F.lit("")), F.lit(eos))
    header = F.concat(F.lit(fixed.CHATML_START), role, F.lit("\n"))
    return F.when(opens & (role == "assistant"), body).otherwise(F.concat(header, body))


def _chatml(messages: Column, eos: str, add_generation_prompt: bool) -> Column:
    parts = F.transform(
        messages, lambda m, i: chatml_message(m["role"], m["content"], i == 0, eos)
    )
    text = F.array_join(parts, "")
    return F.concat(text, F.lit(fixed.CHATML_CUE)) if add_generation_prompt else text


def _llama(messages: Column, eos: str, bos: str) -> Column:
    spoken = F.filter(messages, lambda m: m["role"].isin("user", "assistant"))
    parts = F.transform(
        spoken,
        lambda m: F.when(
            m["role"] == "user",
            F.concat(
                F.lit(fixed.INST_OPEN),
                F.coalesce(m["content"], F.lit("")),
                F.lit(fixed.INST_CLOSE),
            ),
        ).otherwise(F.concat(F.coalesce(m["content"], F.lit("")), F.lit(eos))),
    )
    return F.concat(F.lit(bos), F.array_join(parts, ""))


def pick_template(own_template: str | None, relax: bool = True, generating: bool = False) -> str:
    """Template name for a tokenizer's own template text (None if it has none).

    ``own`` means: keep what the tokenizer brings.
    """
    if generating or own_template is None:
        return "chatml"
    if relax and fixed.INST_OPEN in own_template:
        return "llama"
    return "own"


def render(
    messages: Column,
    template: str = "chatml",
    eos: str | None = None,
    bos: str | None = None,
    add_generation_prompt: bool = False,
) -> Column:
    """Conversation text.  The llama template has no generation cue."""
    if template == "chatml":
        return _chatml(messages, fixed.CHATML_END if eos is None else eos, add_generation_prompt)
    if template == "llama":
        return _llama(
            messages,
            fixed.LLAMA_EOS if eos is None else eos,
            fixed.LLAMA_BOS if bos is None else bos,
        )
    raise ValueError(f"no native rendering for template {template!r}")
