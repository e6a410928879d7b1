"""Prompt texts and the columns built from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# --- fixed values: texts that must appear exactly so in the results -----------------
PREAMBLE_WITH_INPUT = (
    "Below is an instruction that describes a task, paired with an input that provides further context. "
    "Write a response that appropriately completes the request.\n\n"
)
PREAMBLE = (
    "Below is an instruction that describes a task. "
    "Write a response that appropriately completes the request.\n\n"
)
INSTRUCTION_HEAD = "### Instruction:\n"
INPUT_HEAD = "### Input:\n"
RESPONSE_HEAD = "### Response:\n"
RESPONSE_MARK = "### Response:"
HUMAN_TEMPLATE = "Human: {}\nAssistant: "
QA_BEGIN = "BEGINNING OF CONVERSATION: "
QA_USER = "USER: "
QA_ASSISTANT = "ASSISTANT:"
SYSTEM_OPEN = "[INST] <<SYS>>\n"
SYSTEM_CLOSE = "\n<</SYS>>\n\n"
INSTRUCTION_CLOSE = " [/INST]"
DEFAULT_SYSTEM_TEXT = "你是一个乐于助人的助手。"
ROLE_USER = "USER:"
ROLE_ASSISTANT = "ASSISTANT:"
END_OF_TEXT = "</s>"
DIALOGUE_USER = "prompter:"
DIALOGUE_ASSISTANT = "assistant:"
DIALOGUE_USER_OUT = "\nHuman: "
DIALOGUE_ASSISTANT_OUT = "\nAssistant: "
REWARD_TEMPLATE = "{input} <rm_score>: {reward} "
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# ------------------------------------------------------------------------------------

# The same characters as a Java class. Latin ones share a bit set and the rest is looked at
# only from U+1680 on, so ordinary letters cost two tests.
SPACE_CLASS = (
    r"\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
)


def fill(template: str, value: Column) -> Column:
    """Put ``value`` where ``template`` has ``{}``."""
    before, after = template.split("{}", 1)
    return F.concat(F.lit(before), value, F.lit(after))


def instruction_prompt(instruction: Column, context: Column | None = None) -> Column:
    """Instruction text with a context block where the context is neither null nor empty."""
    plain = F.concat(
        F.lit(PREAMBLE + INSTRUCTION_HEAD), instruction, F.lit("\n\n" + RESPONSE_HEAD)
    )
    if context is None:
        return plain
    full = F.concat(
        F.lit(PREAMBLE_WITH_INPUT + INSTRUCTION_HEAD),
        instruction,
        F.lit("\n\n" + INPUT_HEAD),
        context,
        F.lit("\n\n" + RESPONSE_HEAD),
    )
    return F.when(F.length(context) >= 1, full).otherwise(plain)


def scrub_roles(text: Column) -> Column:
    """Drop the user and assistant markers of a labelled chat."""
    return F.replace(F.replace(text, F.lit(ROLE_USER), F.lit("")), F.lit(ROLE_ASSISTANT), F.lit(""))


def scrub_end(text: Column) -> Column:
    return F.replace(text, F.lit(END_OF_TEXT), F.lit(""))


def rewrite_dialogue(text: Column) -> Column:
    """Turn ``prompter:``/``assistant:`` dialogues into Human/Assistant turns."""
    users = F.replace(text, F.lit(DIALOGUE_USER), F.lit(DIALOGUE_USER_OUT))
    both = F.replace(users, F.lit(DIALOGUE_ASSISTANT), F.lit(DIALOGUE_ASSISTANT_OUT))
    rewritten = F.concat(both, F.lit(DIALOGUE_ASSISTANT_OUT))
    return F.when(F.startswith(text, F.lit(DIALOGUE_USER)), rewritten).otherwise(text)


def render_turns(
    turns: Column, role: str, value: str, marker: str, template: str = "{}"
) -> Column:
    """Join turns to one text; turns whose role contains ``marker`` go through the template."""
    return F.array_join(
        F.transform(
            turns,
            lambda t: F.when(F.contains(t[role], F.lit(marker)), fill(template, t[value])).otherwise(
                F.concat(t[value], F.lit("\n"))
            ),
        ),
        "",
    )


def all_but_last(turns: Column) -> Column:
    return F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))


def qa_text(question: Column, answer: Column) -> Column:
    """Question and answer in the form the safety scorer reads."""
    return F.concat(
        F.lit(QA_BEGIN + QA_USER), question, F.lit(" " + QA_ASSISTANT), answer
    )


def system_chat(instruction: Column, system_text: str = DEFAULT_SYSTEM_TEXT) -> Column:
    return F.concat(
        F.lit(SYSTEM_OPEN + system_text + SYSTEM_CLOSE), instruction, F.lit(INSTRUCTION_CLOSE)
    )


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def between(text: Column, after: str, before: str) -> Column:
    """Text after the last ``after`` and before the first following ``before``, stripped."""
    tail = F.element_at(F.split(text, _quoted(after)), -1)
    return strip(F.element_at(F.split(tail, _quoted(before)), 1))


def strip_echo(text: Column, mark: str = RESPONSE_MARK) -> Column:
    """Generated part of an echoed prompt: after the first mark, up to the next one."""
    return strip(F.try_element_at(F.split(text, _quoted(mark)), F.lit(2)))


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"
