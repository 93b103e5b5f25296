"""Splitting text into pre-tokens exactly as a tokenizer library does, and bytes as printable characters."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import regex

#: The pattern that `units` relies on, by value: white space never follows anything else inside a match.
UNIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The characters with the Unicode property White_Space.
_SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUNS = re.compile(f"([{_SPACES}]{{2,}})")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte: Latin-1 where that prints, else the next from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def _ranges(points: list[int]) -> str:
    out: list[list[int]] = []
    for p in points:
        if out and p == out[-1][1] + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(rf"\U{a:08X}-\U{b:08X}" for a, b in out)


def splitter(pattern: str, members: Callable[[str, str], str]) -> Callable[[str], list[str]]:
    """A function that finds all matches of ``pattern``, with the library's own idea of letters and numbers.

    Unicode versions differ between libraries. ``members(cls, characters)`` says which of ``characters`` belong to the
    class ``cls`` (``\\p{L}`` or ``\\p{N}``) in the library; texts that hold a character on which it differs from the
    regex module are split by a pattern that spells the difference out, all others by the plain pattern.
    """
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    own, odd = pattern, []
    for cls in (r"\p{L}", r"\p{N}"):
        here = set(regex.findall(cls, everything))
        there = set(members(cls, "".join(sorted(here | set(regex.findall(r"[\p{L}\p{N}\p{M}\p{So}\p{Cn}]", everything[:0x20000]))))))
        extra, lacking = sorted(map(ord, there - here)), sorted(map(ord, here - there))
        odd += [*extra, *lacking]
        # inside a set the class is a nested set, so that it also serves in the complement
        spelled = f"[[{cls}{_ranges(extra)}]--[{_ranges(lacking)}]]" if lacking else f"[{cls}{_ranges(extra)}]"
        own = own.replace(cls, spelled) if extra or lacking else own
    plain = regex.compile(pattern).findall
    if not odd:
        return plain
    strange, exact = regex.compile(f"[{_ranges(sorted(set(odd)))}]").search, regex.compile(own, regex.V1).findall
    return lambda text: plain(text) if text.isascii() or not strange(text) else exact(text)


def units(text: str) -> Iterator[tuple[bool, list[str]]]:
    """``text`` as groups of units that can each be split apart from the others: (after a space, units).

    For UNIT_PATTERN only. A unit stands between single spaces or line ends; where the flag is set, one space belongs
    before each unit of the group. Of a run of two or more white-space characters all but the last are a unit, and the
    last, if it is a space, belongs to the unit behind it. So whatever repeats in a text repeats as a unit, and the
    pattern has to be run once for each distinct unit.
    """
    parts = _RUNS.split(text)
    spaced, last = False, len(parts) - 1
    for at in range(0, last + 1, 2):
        for k, line in enumerate(parts[at].split("\n")):
            if k:
                yield False, ["\n"]
            first, *rest = line.split(" ")
            yield spaced and not k, [first]
            if rest:
                yield True, rest
        if at < last:
            run = parts[at + 1]
            if at + 1 == last - 1 and not parts[last]:
                yield False, [run]
                return
            spaced = run[-1] == " "
            yield False, [run[:-1]] if spaced else [run[:-1], run[-1]]


def split_all(split: Callable[[str], list[str]], wanted: list[str]) -> tuple[list[str], list[int]]:
    """The pre-tokens of all ``wanted`` units of `units`, one after another, and how many each unit has."""
    plain = [u for u in wanted if not (u[:1] != " " and u[:1].isspace() or u[-1:].isspace() or not u)]
    parts: dict[str, list[str]] = {}
    if len(plain) < len(wanted):  # white space at an end could join the line ends put between units
        known = set(plain)
        parts = {u: split(u) for u in wanted if u not in known}
    # a line end before anything but white space, or before one space and that, is a match of its own
    found = split("\n".join(plain))
    ends = [k for k, token in enumerate(found) if token == "\n"]
    sizes = [b - a - 1 for a, b in zip([-1, *ends], [*ends, len(found)])]
    if not parts:
        return [t for t in found if t != "\n"], sizes
    at, flat, counts, k = 0, [], [], 0
    for u in wanted:
        if u in parts:
            flat += parts[u]
            counts.append(len(parts[u]))
        else:
            flat += found[at : at + sizes[k]]
            counts.append(sizes[k])
            at += sizes[k] + 1
            k += 1
    return flat, counts


class Memory:
    """What is known of units at a line's start and of units after a space, up to ``most`` of both.

    A full memory stays as it is while it serves; when a group of texts finds under two fifths of its units in it,
    it starts anew.
    """

    def __init__(self, most: int, longest: int, learn: Callable[[list[str]], list]):
        self.most, self.longest, self.learn = most, longest, learn
        self.known: tuple[dict, dict] = ({}, {})

    def look(self, groups: list[list[tuple[bool, list[str]]]]) -> list[list]:
        """For each group of `units` what is known of its units, in order."""
        seen: tuple[set[str], set[str]] = (set(), set())
        for group in groups:
            for spaced, unit in group:
                seen[spaced].update(unit)
        fresh = [here.difference(known) for here, known in zip(seen, self.known)]
        full = sum(map(len, self.known)) + sum(map(len, fresh)) > self.most
        if full and sum(map(len, fresh)) > 0.6 * sum(map(len, seen)):
            for known in self.known:
                known.clear()
            fresh, full = list(seen), False
        for known, new, lead in zip(self.known, fresh, ("", " ")):
            wanted = list(new)
            known.update(zip(wanted, self.learn([lead + u for u in wanted] if lead else wanted)))
        get = [known.__getitem__ for known in self.known]
        out = [list(chain.from_iterable([map(get[spaced], unit) for spaced, unit in group])) for group in groups]
        for known, new in zip(self.known, fresh):
            for u in new:
                if full or len(u) > self.longest:
                    del known[u]
        return out
