"""Burrows-Wheeler transforms of shards of strings over steps of eight bytes, their merge by interleave refinement, and
the common prefixes and repeated intervals that fall out of it."""

from __future__ import annotations

import numpy as np

#: Bytes of a step: a transform holds for each suffix the STEP bytes before it, so a round of the merge refines by STEP.
STEP = 8
_NONE = np.uint64(0)


class Shard:
    """The suffixes of some strings in order, strings padded with zeros without end.

    before: for each suffix the code of the STEP bytes before it (0 if it has fewer before it); ends: the codes of the
    last STEP suffixes of each string, in string order, after which nothing follows; string and offset of each suffix."""

    def __init__(self, before: np.ndarray, ends: np.ndarray, string: np.ndarray, offset: np.ndarray):
        self.before, self.ends, self.string, self.offset = before, ends, string, offset


def codes(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every suffix its first STEP bytes as one number, in order of strings and offsets; and string and offset."""
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    n = int(lens.sum())
    string = np.repeat(np.arange(len(strings)), lens)
    offset = np.arange(n) - np.repeat(np.cumsum(lens) - lens, lens)
    left = np.repeat(lens, lens) - offset
    # bytes of UTF-8 are below 0xF8: one more still fits a byte and leaves 0 to what follows a string's end
    text = np.concatenate((np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1), np.zeros(STEP, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(STEP):
        key = (key << np.uint64(8)) | np.where(j < left, text[j : j + n], np.uint64(0))
    return key, string, offset


def build(strings: list[bytes], first: int = 0) -> Shard:
    """The transform of strings, sorted by prefix doubling from their codes; string numbers count from `first`."""
    key, string, offset = codes(strings)
    n = len(key)
    lens = np.bincount(string, minlength=len(strings)) if len(strings) else np.zeros(0, np.int64)
    left = lens[string] - offset if n else offset
    at, span = np.arange(n), STEP
    order = np.argsort(key)  # what is equal is told apart below
    rank = np.empty(n, np.int64)
    part = key[order][1:] != key[order][:-1]
    while n:
        rank[order] = np.concatenate(([0], np.cumsum(part)))
        if part.all():
            break
        then = np.where(left > span, rank[np.minimum(at + span, n - 1)] + 1, 0)
        if span >= int(lens.max()):  # equal to their ends: string order decides
            then = string
        both = rank * (n + 1 + len(strings)) + then
        order = np.argsort(both)
        part = both[order][1:] != both[order][:-1]
        span *= 2
    before = np.zeros(n, np.uint64)
    has = offset >= STEP
    before[has] = key[at[has] - STEP]
    return Shard(before[order], key[left <= STEP], string[order] + first, offset[order])


def _dealt(code: np.ndarray) -> np.ndarray:
    """The stable order of dense numbers, 16 bits at a time (numpy then deals them out instead of comparing)."""
    order = np.argsort(code.astype(np.uint16), kind="stable")
    if len(code) and int(code.max()) >= 1 << 16:
        order = order[np.argsort((code[order] >> 16).astype(np.uint16), kind="stable")]
    return order


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, offset, parted, group) of the suffixes of all shards in the order of their first `depth` bytes (rounded
    up to steps), without sorting suffixes.

    The interleave of depth h + STEP is the stable distribution, by the bytes before them, of the suffixes in the order
    of depth h: each round reads the transforms in step and deals the marks out, which say whose suffix comes next.
    Alongside goes the number of each suffix's interval (suffixes that agree so far); parted is the round after which a
    suffix and the one before it no longer agree, 0 if they still do at the end."""
    mark_kind = np.uint8 if len(shards) <= 256 else np.uint16
    flat = np.concatenate([s.before for s in shards])
    ends = np.concatenate([s.ends for s in shards])
    n = len(flat)
    seen, dense = np.unique(np.concatenate((flat, ends)), return_inverse=True)
    none = len(seen) > 0 and seen[0] == _NONE
    flat, ends = dense[:n].astype(np.int32) + (not none), dense[n:].astype(np.int32) + (not none)  # 0: nothing before
    mark = np.concatenate([np.full(len(s.before), k, mark_kind) for k, s in enumerate(shards)])
    end_mark = np.concatenate([np.full(len(s.ends), k, mark_kind) for k, s in enumerate(shards)])
    before, group = flat, np.zeros(n, np.int32)
    parted = np.zeros(n, np.int16)
    rounds = -(-depth // STEP)
    for turn in range(1, rounds + 1):
        has = before > 0
        code = np.concatenate((ends, before[has]))
        mark = np.concatenate((end_mark, mark[has]))
        group = np.concatenate((np.zeros(len(ends), np.int32), group[has] + 1))
        order = _dealt(code)
        mark, code, group = mark[order], code[order], group[order]
        part = np.ones(n, bool)
        part[1:] = (code[1:] != code[:-1]) | (group[1:] != group[:-1])
        parted[(parted == 0) & part] = turn
        group = np.cumsum(part, dtype=np.int32) - 1
        before = np.empty(n, np.int32)
        before[np.argsort(mark, kind="stable")] = flat
    turn = np.argsort(mark, kind="stable")
    string, offset = np.empty(n, np.int64), np.empty(n, np.int64)
    string[turn] = np.concatenate([s.string for s in shards])
    offset[turn] = np.concatenate([s.offset for s in shards])
    return string, offset, parted, group


def common_prefixes(strings: list[bytes], string: np.ndarray, offset: np.ndarray, parted: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix of a merge the bytes it shares with the one before it, `depth` at most: the rounds that both
    stayed together, and what their next STEP bytes agree in."""
    if not len(string):
        return np.zeros(0, np.int64)
    key, _, _ = codes(strings)
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    begin = np.cumsum(lens) - lens
    together = np.maximum(parted.astype(np.int64) - 1, 0) * STEP
    held = np.where(parted > 0, together, depth)
    at = offset + together
    code = np.where(at < lens[string], key[np.minimum(begin[string] + at, len(key) - 1)], _NONE)
    other = np.where(offset[:-1] + together[1:] < lens[string[:-1]], key[np.minimum(begin[string[:-1]] + offset[:-1] + together[1:], len(key) - 1)], _NONE)
    differ = (code[1:] ^ other).astype(np.uint64)
    agree = np.zeros(len(differ), np.int64)
    for j in range(1, STEP + 1):
        agree += (differ >> np.uint64(8 * (STEP - j))) == 0
    short = np.minimum(lens[string] - offset, depth)
    out = np.zeros(len(string), np.int64)
    out[1:] = np.minimum(np.minimum(np.where(parted[1:] > 0, held[1:] + agree, depth), short[1:]), short[:-1])
    return out


def repeated(strings: list[bytes], times: list[int], depth: int, shard_bytes: int) -> list[np.ndarray]:
    """For each string which of its windows of `depth` bytes also start elsewhere, in it or in another string, a string
    counting as often as `times` says. Shards of about shard_bytes are transformed one by one and merged; windows are
    repeated where common prefixes of `depth` bytes hold an interval of weight two or more together."""
    shards, part, size = [], [], 0
    for i, s in enumerate(strings):
        if part and size + len(s) > shard_bytes:
            shards.append(build(part, i - len(part)))
            part, size = [], 0
        part.append(s)
        size += len(s)
    shards.append(build(part, len(strings) - len(part)))
    out = [np.zeros(max(0, len(s) - depth + 1), bool) for s in strings]
    string, offset, parted, _ = merge(shards, depth)
    if not len(string):
        return out
    interval = np.cumsum(common_prefixes(strings, string, offset, parted, depth) < depth) - 1
    weight = np.bincount(interval, weights=np.asarray(times, np.float64)[string])
    lens = np.fromiter(map(len, strings), np.int64, len(strings))
    here = (weight[interval] >= 2) & (lens[string] - offset >= depth)
    begin = np.concatenate(([0], np.cumsum([len(x) for x in out])))
    flat = np.zeros(begin[-1], bool)
    flat[begin[string[here]] + offset[here]] = True
    return [flat[begin[i] : begin[i + 1]] for i in range(len(strings))]
