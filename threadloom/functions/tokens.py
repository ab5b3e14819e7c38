"""Token estimates, tokenizer scales and prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes a token by block kind, and tokens of a block's frame and of an image.
BYTES_PER_TOKEN = {"text": 2.5, "tool_input": 2.1, "tool_result": 2.2, "signature": 3.6, "marker": 1.5}
BLOCK_TOKENS, IMAGE_TOKENS = 12, 3000

# USD for a million tokens (input, cache read, cache write, output) by prefix; the first that fits counts.
PRICES = [
    (("claude-opus-4-5", "claude-opus-4-6", "claude-4-5-opus"), (5.0, 0.50, 6.25, 25.0)),
    (("claude-opus-4", "claude-3-opus"), (15.0, 1.50, 18.75, 75.0)),
    (("claude-sonnet-4", "claude-3-7-sonnet", "claude-3-5-sonnet", "claude-4-sonnet"), (3.0, 0.30, 3.75, 15.0)),
    (("claude-haiku-4", "claude-4-5-haiku"), (1.0, 0.10, 1.25, 5.0)),
    (("claude-3-5-haiku",), (0.80, 0.08, 1.0, 4.0)),
    (("claude-3-haiku",), (0.25, 0.03, 0.30, 1.25)),
    (("gpt-5-nano",), (0.05, 0.005, 0.05, 0.40)),
    (("gpt-5-mini",), (0.25, 0.025, 0.25, 2.0)),
    (("gpt-5",), (1.25, 0.125, 1.25, 10.0)),
    (("gpt-4.1-nano",), (0.10, 0.025, 0.10, 0.40)),
    (("gpt-4.1-mini", "gpt-4o-mini"), (0.40, 0.10, 0.40, 1.60)),
    (("gpt-4.1",), (2.0, 0.50, 2.0, 8.0)),
    (("gpt-4o",), (2.50, 1.25, 2.50, 10.0)),
    (("codex-mini",), (1.50, 0.375, 1.50, 6.0)),
    (("o4-mini", "o3-mini", "o1-mini"), (1.10, 0.275, 1.10, 4.40)),
    (("o3",), (2.0, 0.50, 2.0, 8.0)),
    (("o1",), (15.0, 7.50, 15.0, 60.0)),
    (("gemini-2.5-pro", "gemini-3-pro", "gemini-1.5-pro"), (1.25, 0.3125, 1.25, 10.0)),
    (("gemini-2.5-flash", "gemini-3-flash"), (0.30, 0.075, 0.30, 2.50)),
    (("gemini-2.0-flash", "gemini-1.5-flash"), (0.10, 0.025, 0.10, 0.40)),
    (("deepseek-reasoner", "deepseek-r1"), (0.55, 0.14, 0.55, 2.19)),
    (("deepseek-chat", "deepseek-v3"), (0.27, 0.07, 0.27, 1.10)),
    (("grok-3-mini",), (0.30, 0.075, 0.30, 0.50)),
    (("grok-3", "grok-4"), (3.0, 0.75, 3.0, 15.0)),
    (("qwen3-coder", "qwen-max"), (1.20, 0.30, 1.20, 6.0)),
]

# Tokenizer scale by model prefix pattern, beside the claude rule below.
SCALES = [
    (r"^(gpt-3\.5|gpt-4$|gpt-4-|gpt-4\.|gpt-4o|gpt-5$|gpt-5-|gpt-5\.|chatgpt-4o|o1$|o1-|o3$|o3-|o4$|o4-|codex)", 1.25),
    (r"^gemini-", 1.30),
    (r"^(qwen|grok-|grok2|grok3|grok4)", 1.20),
    (r"^(deepseek|kimi|moonshot|glm-|mistral-|codestral|devstral)", 1.18),
]


def effective_bytes(text: Column) -> Column:
    """ASCII characters weigh 1, all others 2."""
    return 2 * F.char_length(text) - F.char_length(F.regexp_replace(text, r"[^\x00-\x7F]", ""))


def estimate(size: Column, kind: str = "text") -> Column:
    """Tokens of ``size`` effective bytes."""
    return F.ceil(size / BYTES_PER_TOKEN[kind])


def block_tokens(text: Column, kind: str = "text") -> Column:
    return BLOCK_TOKENS + estimate(F.coalesce(effective_bytes(text), F.lit(0)), kind)


def bare_model(model: Column) -> Column:
    return F.lower(F.element_at(F.split(F.trim(model), "/"), -1))


def tokenizer_scale(model: Column) -> Column:
    """How much a model family's token counts exceed the base estimate's."""
    name = bare_model(model)
    # the first one- or two-digit part after the family is the major version, the part after it the minor
    parts = F.filter(F.split(F.substr(name, F.lit(8)), "-"), lambda p: p.isNotNull())
    at = F.array_position(F.transform(parts, lambda p: p.rlike(r"^\d{1,2}$")), True)
    major = F.get(parts, (at - 1).cast("int")).cast("int")
    minor_text = F.get(parts, at.cast("int"))
    minor = F.when(minor_text.rlike(r"^\d{1,2}$"), minor_text.cast("int")).otherwise(F.lit(0))
    claude = F.when((at > 0) & ((major < 4) | ((major == 4) & (minor <= 6))), F.lit(1.35)).otherwise(F.lit(1.0))
    out = F.when(F.startswith(name, F.lit("claude-")), claude)
    for pattern, scale in SCALES:
        out = out.when(name.rlike(pattern), F.lit(scale))
    return out.otherwise(F.lit(1.0))


def price(model: Column) -> Column:
    """The model's prices as a struct, or null."""
    name = bare_model(model)
    names = ("input", "cache_read", "cache_write", "output")
    out = None
    for prefixes, values in PRICES:
        fits = F.lit(False)
        for p in prefixes:
            fits = fits | F.startswith(name, F.lit(p))
        row = F.struct(*[F.lit(v).alias(n) for n, v in zip(names, values)])
        out = F.when(fits, row) if out is None else out.when(fits, row)
    return out


def estimated_cost(model: Column, cost: Column, tokens: dict[str, Column]) -> Column:
    """The reported cost, else the price table's."""
    rates = price(model)
    total = sum((F.coalesce(tokens[n], F.lit(0)) * rates[n] for n in ("input", "cache_read", "cache_write", "output")), F.lit(0.0))
    return F.coalesce(cost, total / 1_000_000.0)
