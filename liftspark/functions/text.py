"""Text functions written as plain Python; each lowers to a column where an exact one exists."""

from __future__ import annotations

import json
import re
import unicodedata

from ..udf import func

SPACE = re.compile(r"\s+")
TAG = re.compile(r"<[^>]+>")
LINK = re.compile(r"https?://[^\s<>\"]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")

#: Typographic punctuation and its plain form: fixed values.
PUNCTUATION = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "、": ",", "。": ".", "，": ",", "！": "!", "？": "?", "：": ":", "；": ";"}
EXPANDED = {"…": "...", "–": " - ", "—": " - ", "™": ""}


@func(return_dtype="bool")
def length_between(text, low=200, high=20000):
    n = len(text)
    return low <= n <= high


@func(return_dtype="float64")
def alnum_ratio(text):
    if not text:
        return 0.0
    return sum(1 for c in text if c.isalnum()) / len(text)


@func(return_dtype="bool")
def alnum_at_least(text, ratio=0.72):
    return sum(1 for c in text if c.isalnum()) / len(text) >= ratio


@func(return_dtype="bool")
def alnum_at_least_or_empty(text, ratio=0.72):
    if not text:
        return False
    return sum(1 for c in text if c.isalnum()) / len(text) >= ratio


@func(return_dtype="string")
def normalize_punctuation(text):
    return text.translate(str.maketrans(PUNCTUATION))


@func(return_dtype="string")
def expand_punctuation(text):
    return text.translate(str.maketrans(EXPANDED))


@func(return_dtype="string")
def normalize_space(text):
    return SPACE.sub(" ", text).strip()


@func(return_dtype="string")
def normalize_space_em(text):
    return SPACE.sub(" ", text).strip()


@func(return_dtype="string")
def strip_tags(text):
    return TAG.sub(" ", text)


@func(return_dtype="string", deterministic=True)
def clean_links(text):
    return LINK.sub("", text)


@func(return_dtype="string", deterministic=True)
def fix_unicode(text):
    return unicodedata.normalize("NFC", text)


@func(return_dtype="string", deterministic=True)
def first_key(props):
    return next(iter(json.loads(props)), None)
