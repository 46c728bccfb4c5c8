"""The pieces between which byte-pair merges never reach, found in numpy over many texts at once."""

from __future__ import annotations

import unicodedata

import numpy as np

from .textbytes import PIECE, mix, worker_cache, _powers

LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Unicode's White_Space.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    table[WHITE_SPACE] = SPACE
    return table


def classes() -> np.ndarray:
    """The class of every code point."""
    cache = worker_cache()
    if "classes" not in cache:
        cache["classes"] = _classes()
    return cache["classes"]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts, offsets)."""
    offs = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offs[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offs


def _runs(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and classes of the runs of one class; a run never crosses a text's end."""
    kind = classes()[cps]
    new = np.empty(len(cps), bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    cuts = offs[:-1]
    new[cuts[cuts < len(cps)]] = True
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], len(cps)), kind[starts]


def _contractions(cps, starts, ends, kinds, offs, free) -> np.ndarray:
    """How many letters each run gives to an apostrophe before it: 's 't 'm 'd take one, 're 've 'll two."""
    given = np.zeros(len(starts), np.int64)
    if len(starts) < 2:
        return given
    after = np.flatnonzero((kinds[1:] == LETTER) & (kinds[:-1] == OTHER) & (ends[:-1] - starts[:-1] == 1) & free[:-1]) + 1
    after = after[(cps[starts[after] - 1] == ord("'")) & ~np.isin(starts[after], offs)]
    first = cps[starts[after]]
    given[after[np.isin(first, [ord(c) for c in "stmd"])]] = 1
    long = after[ends[after] - starts[after] > 1]
    a, b = cps[starts[long]], cps[starts[long] + 1]
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    given[long[two]] = 2
    return given


def spaced_pieces(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of a byte-level vocabulary: a word takes the one space before it.

    Of white space before a word, all but its last character is one piece; the
    last one joins the word if it is a space, and is a piece by itself if not.
    """
    if not len(cps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends, kinds = _runs(cps, offs)
    space = kinds == SPACE
    followed = np.zeros(len(starts), bool)
    followed[:-1] = space[:-1] & ~np.isin(starts[1:], offs)
    joins = followed & (cps[ends - 1] == 0x20)
    joined = np.zeros(len(starts), bool)
    joined[1:] = joins[:-1]
    given = _contractions(cps, starts, ends, kinds, offs, ~joined)
    taken = np.zeros(len(starts), np.int64)
    taken[:-1] = given[1:]
    s = starts - joined + given
    e = np.where(followed, ends - 1, ends) + taken
    alone = np.flatnonzero(followed & ~joins)
    s = np.concatenate([s, ends[alone] - 1])
    e = np.concatenate([e, ends[alone]])
    full = e > s
    s, e = s[full], e[full]
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def bare_pieces(cps: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of a word-end vocabulary: words, single digits, runs of marks; white space goes."""
    if not len(cps):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts, ends, kinds = _runs(cps, offs)
    given = _contractions(cps, starts, ends, kinds, offs, np.ones(len(starts), bool))
    taken = np.zeros(len(starts), np.int64)
    taken[:-1] = given[1:]
    s, e = starts + given, ends + taken
    keep = ((kinds == LETTER) | (kinds == OTHER)) & (e > s)
    digits = np.flatnonzero(classes()[cps] == NUMBER)
    s, e = np.concatenate([s[keep], digits]), np.concatenate([e[keep], digits + 1])
    order = np.argsort(s, kind="stable")
    return s[order], e[order]


def piece_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of code-point ranges in ascending order."""
    out = np.empty(len(starts), np.uint64)
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            base = int(starts[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + PIECE, "right")))
            size = int(ends[hi - 1]) - base
            power, inverse = _powers(size + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum(mix(cps[base : base + size].astype(np.uint64) + np.uint64(1)) * power[:size], out=total[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
            lo = hi
    return out


def cut_specials(texts: list[str], specials: dict[str, int]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts split at special strings: (segments, their text's number, the special's id after each segment or -1)."""
    segments, owner, after = [], [], []
    for i, t in enumerate(texts):
        rest = t
        while rest is not None:
            at, name = min(((rest.find(s), s) for s in specials if s in rest), default=(-1, ""))
            segments.append(rest if at < 0 else rest[:at])
            owner.append(i)
            after.append(-1 if at < 0 else specials[name])
            rest = None if at < 0 else rest[at + len(name) :]
    return segments, np.array(owner, np.int64), np.array(after, np.int64)
