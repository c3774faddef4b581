"""Column expressions over texts: normal forms, identities, answers, trigram vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_form(text: Column) -> Column:
    """Texts with one normal form ask the same: lower case, no full stops or commas, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(text), ".,", "  "), r"\s+", " "))


def predicate_id(text: Column) -> Column:
    """Twelve hex digits of the SHA-1 of the text as it stands."""
    return F.substring(F.sha1(text), 1, 12)


def yes_no(reply: Column) -> Column:
    """A model's short reply as a boolean: by its first word, else by whether it says yes anywhere."""
    bare = F.regexp_replace(F.lower(F.trim(reply)), r"^[\s\"'.`*(\[]+|[\s\"'.`*)\]]+$", "")
    return F.when(bare.rlike("^(yes|true)"), True).when(bare.rlike("^(no|false)"), False).otherwise(bare.contains("yes"))


def clean_document(text: Column, most: int | None = None) -> Column:
    """White space collapsed; cut to ``most`` characters only if that is given."""
    whole = F.trim(F.regexp_replace(text, r"\s+", " "))
    return whole if most is None else F.substring(whole, 1, most)


def trigram_counts(text: Column, dim: int = 256) -> Column:
    """Counts of character trigrams by the first four bytes of their MD5 modulo ``dim``, as an array."""
    tidy = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(tidy) - 2, F.lit(1))), lambda i: F.substring(tidy, i, F.lit(3)))
    slots = F.transform(grams, lambda g: (F.conv(F.substring(F.md5(g), 1, 8), 16, 10).cast("long") % dim).cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: F.size(F.filter(slots, lambda s: s == d)).cast("double"))


def call_cost(prompt_tokens: Column, output_tokens: Column, prompt_price: float = 0.15, output_price: float = 0.60) -> Column:
    """Dollars at prices per million tokens."""
    return prompt_tokens * (prompt_price / 1e6) + output_tokens * (output_price / 1e6)
