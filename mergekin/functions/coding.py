"""The number of bits in which an order-0 arithmetic coder tells a text."""

from __future__ import annotations

from collections import Counter
from math import prod

_STOP = "\x00"


def train(text: str) -> Counter:
    """How often each character occurs, the end mark once; NUL must not occur in text."""
    if _STOP in text:
        raise ValueError("the end mark occurs in the text")
    return Counter(text + _STOP)


def bits(text: str, counts: Counter) -> int:
    """Bits needed to tell the text and its end: the least n for which 2^-n is half the interval's width or less, the width being the product of the shares."""
    if unknown := set(text) - set(counts):
        raise KeyError(min(unknown))
    told = text + _STOP
    width, whole = prod(counts[c] for c in told), counts.total() ** len(told)
    return (-(-2 * whole // width) - 1).bit_length()
