"""What may be read, suggested or learnt in a field, by its descriptor's bits. Unknown kinds are restricted."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Masks, classes, variations and flags of the descriptors.
MASK_CLASS, MASK_VARIATION = 0xF, 0xFF0
TEXT, NUMBER, PHONE, DATETIME = 1, 2, 3, 4
TEXT_REASONS = {0x80: "PASSWORD", 0x90: "VISIBLE_PASSWORD", 0xE0: "WEB_PASSWORD", 0x20: "EMAIL", 0xD0: "WEB_EMAIL", 0x10: "URI"}
SAFE_TEXT = (0x00, 0x30, 0x40, 0x50, 0x60, 0x70, 0xA0, 0xB0, 0xC0)
NUMERIC_PASSWORD, NO_SUGGESTIONS, NO_LEARNING = 0x10, 0x80000, 0x1000000
PERSON_NAME, POSTAL_ADDRESS = 0x60, 0x70
# Words of a hint or name that speak of a one-time code.
CODE_WORDS = (
    "otp", "one-time", "one time", "onetime", "passcode", "pin", "verification code", "verify code", "security code", "auth code", "2fa", "mfa",
    "sms code", "confirmation code", "קוד אימות", "קוד חד", "סיסמה חד", "קוד אבטחה", "קוד זיהוי",
)


def one_time_code(kind: Column, hint: Column, name: Column, length: Column) -> Column:
    """A hint or name that speaks of a code, or a number of four to eight digits."""
    says = F.lower(F.concat_ws(" ", hint, name)).rlike("|".join(CODE_WORDS))
    return says | F.coalesce((kind.bitwiseAND(F.lit(MASK_CLASS)) == NUMBER) & length.between(4, 8), F.lit(False))


def reasons(kind: Column, options: Column, hint: Column, name: Column, length: Column) -> Column:
    """Array of the reasons to restrict a field, in a fixed order; empty if there is none."""
    cls, var = kind.bitwiseAND(F.lit(MASK_CLASS)), kind.bitwiseAND(F.lit(MASK_VARIATION))
    text = F.lit(None).cast("string")
    by = F.when(var.isin(*SAFE_TEXT), text)
    for v, reason in TEXT_REASONS.items():
        by = by.when(var == v, F.lit(reason))
    by = by.otherwise(F.lit("UNRECOGNISED_INPUT_TYPE"))
    first = F.when(cls == TEXT, by).when(cls == NUMBER, F.lit("NUMBER")).when(cls == PHONE, F.lit("PHONE")).when(~cls.isin(0, DATETIME), F.lit("UNRECOGNISED_INPUT_TYPE"))
    return F.array_compact(F.array(
        first,
        F.when((cls == NUMBER) & (var == NUMERIC_PASSWORD), F.lit("NUMERIC_PASSWORD")),
        F.when(kind.bitwiseAND(F.lit(NO_SUGGESTIONS)) != 0, F.lit("NO_SUGGESTIONS_FLAG")),
        F.when(options.bitwiseAND(F.lit(NO_LEARNING)) != 0, F.lit("NO_PERSONALIZED_LEARNING_FLAG")),
        F.when(one_time_code(kind, hint, name, length), F.lit("OTP_HEURISTIC")),
    ))


def no_learn(kind: Column) -> Column:
    """Why a field that may be read mustn't be learnt from; null if it may."""
    var = kind.bitwiseAND(F.lit(MASK_VARIATION))
    return F.when(kind.bitwiseAND(F.lit(MASK_CLASS)) == TEXT, F.when(var == PERSON_NAME, F.lit("PERSON_NAME")).when(var == POSTAL_ADDRESS, F.lit("POSTAL_ADDRESS")))


def verdict(seen: Column, served: Column) -> Column:
    """Whether no restricted field was served; null if none was seen."""
    return F.when(seen > 0, served == 0)
