"""Chat-style prompt records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.text import ANSWER_PREFIX, BOS, EOS

# Prompt wording that must equal the reference's, spelling included.
SYSTEM = (
    "You are a marketing analyst who specializes in product categorization and feature extraction."
    "Semantic-IDs are {size} integers that each value ranges from <|CODE_0|> to <|CODE_{range}|>, "
    "separated by commands, and placed between <|bos_semantic|> and <|eos_semantic|>."
)
TEMPLATES = (
    "Please analyze the following product and its features: {product_text}. Then, generate "
    "semantic-IDs that meaningfully represent the product.",
    "Analyze this catalog item and convert it into semantic-IDs: {product_text}.",
    "Read the product information and map it to semantic-IDs for recommendation cold-start: "
    "{product_text}.",
    "Remember the following product and summarize it by generating semantic-IDs: {product_text}.",
    "Given the following product, produce semantic-IDs that capture its meaning: {product_text}.",
)
ANSWER = "The semantic-IDs are: "
RECOVER = ". Recover the product name and/or its metadata."


def _turn(role: str, content) -> Column:
    content = F.lit(content) if isinstance(content, str) else content
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def _fill(template: str, product_text: Column) -> Column:
    before, after = template.split("{product_text}")
    return F.concat(F.lit(before), product_text, F.lit(after))


def slots(size: int) -> str:
    """One end marker per code position, to be overwritten by real codes."""
    return EOS * size


def guessing_prompt(product_text, index, size: int, code_range: int, templates=TEMPLATES) -> Column:
    """System, user and answer turns; the user template is chosen by ``index`` in rotation."""
    text = F.col(product_text) if isinstance(product_text, str) else product_text
    index = F.lit(index) if isinstance(index, int) else F.col(index)
    filled = F.array(*[_fill(t, text) for t in templates])
    chosen = F.element_at(filled, (F.pmod(index, F.lit(len(templates))) + 1).cast("int"))
    return F.array(
        _turn("system", SYSTEM.format(size=size, range=code_range)),
        _turn("user", chosen),
        _turn("assistant", f"{ANSWER}{BOS}{slots(size)}{EOS}"),
    )


def reconstruction_prompt(product_text, size: int, code_range: int) -> Column:
    """The reverse chat: codes in the user turn, product text as the answer."""
    text = F.col(product_text) if isinstance(product_text, str) else product_text
    return F.array(
        _turn("system", SYSTEM.format(size=size, range=code_range)),
        _turn("user", f"{ANSWER}{BOS}{slots(size)}{EOS}{RECOVER}"),
        _turn("assistant", F.concat(F.lit(ANSWER_PREFIX), text)),
    )


def reference_text(prompt) -> Column:
    """Content of the last turn."""
    return F.element_at(F.col(prompt), -1)["content"]


def without_answer(prompt) -> Column:
    """All turns but the last."""
    value = F.col(prompt)
    return F.slice(value, F.lit(1), F.greatest(F.size(value) - 1, F.lit(0)))
