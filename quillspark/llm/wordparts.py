"""How word-level tokenizer files cut texts: a fast cut of Latin texts that equals the tokenizer's own."""

from __future__ import annotations

import json
import re
from functools import lru_cache

# Fixed value: the pattern by which the word-level tokenizer file cuts lower-cased text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters up to U+017F. Their small forms stay among them (further on, some do not), and none of them composes anew.
LATIN = "a-zªµºß-öø-ſ"
LATIN_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9²³¹¼½¾]|[^\\s0-9²³¹¼½¾{LATIN}]+")
#: Anything else than blanks, printable ASCII and U+00A1 to U+017F; U+0130, whose small form is two characters, counts as else.
NOT_LATIN = re.compile("[^\t\n\r\x20-\x7e\xa1-įı-ſ]")


def byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: itself if printable, else one from 256 up."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        letters[b] = chr(b) if b in printable else chr(spare)
        spare += b not in printable
    return letters


def read_spec(path: str) -> dict:
    """A tokenizer file's content."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


#: The same, remembered.
spec_of = lru_cache(maxsize=4)(read_spec)


def cuts_words(spec: dict) -> bool:
    """Whether LATIN_PARTS cuts as the file does: lower-casing, white space dropped, words by WORD_PATTERN."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    first = steps[0] if steps else {}
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and bool(first.get("invert"))
    return drops and "Lowercase" in str(spec.get("normalizer")) and (first.get("pattern") or {}).get("Regex", "") == WORD_PATTERN


def added_tokens(spec: dict) -> dict[str, int]:
    """The added tokens, which a tokenizer finds in the raw text before anything else, and their ids."""
    return {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
