"""Token masks as Column expressions (T4, T5) and fixed mask tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mask tokens, numbers kept as they are, string-literal length limit.
STRING_TOKEN = "<str>"
NUMBER_TOKEN = "<num>"
VARIABLE_TOKEN = "<var>"
UNKNOWN_TOKEN = "<unknown>"
INTEGERS_TO_LEAVE = ["0", "1", "32", "64"]
MAX_STRING_LITERAL = 10


def mask_literal(token: Column, lit_type: Column, decl_id: Column, target: Column) -> Column:
    """T4: string literal longer than 10 chars -> <str>; number other than 0, 1, 32, 64 -> <num>;
    the target variable or a reference to it -> <var>; anything else is kept."""
    return (
        F.when(lit_type == "string",
               F.when(F.length(token) > MAX_STRING_LITERAL, F.lit(STRING_TOKEN)).otherwise(token))
        .when(lit_type == "number",
              F.when(token.isin(*INTEGERS_TO_LEAVE), token).otherwise(F.lit(NUMBER_TOKEN)))
        .when(decl_id.isNotNull() & (decl_id == target), F.lit(VARIABLE_TOKEN))
        .otherwise(token)
    )


def mask_target(token: Column, decl_id: Column, target: Column) -> Column:
    """T5: every token that is the target or refers to it -> <unknown>."""
    return F.when(decl_id.isNotNull() & (decl_id == target), F.lit(UNKNOWN_TOKEN)).otherwise(token)
