"""Vectorised hashing of words and word sequences of whole texts (numpy, inside tasks)."""

from __future__ import annotations

SEGMENT = 1 << 20  # bytes hashed at once; a text is cut between words, so memory stays bounded
BASE = 0x9E3779B97F4A7C15 | 1


def mix(x):
    """A 64-bit mixing function over an array of unsigned 64-bit integers."""
    import numpy as np

    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple] = {}


def powers(n: int):
    """BASE ** i and its inverse modulo 2 ** 64, for i below ``n``."""
    import numpy as np

    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        size = max(n, SEGMENT + 1)
        up, down = np.full(size, BASE, np.uint64), np.full(size, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * SEGMENT:
            _POWERS[0] = have
    return have[0][:n], have[1][:n]


def tables():
    """Byte tables: A-Z lower-cased, and the word separators (space and 0x09-0x0D)."""
    import numpy as np

    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    gap = np.zeros(256, dtype=bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    return low, gap


def _segment_words(buf, low, gap):
    """Starts, ends and hashes of the words in a byte array."""
    import numpy as np

    inside = ~gap[buf]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    up, down = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum((low[buf].astype(np.uint64) + np.uint64(1)) * up[:len(buf)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return starts, ends, mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def words(data: bytes):
    """Starts, ends (bytes) and 64-bit hashes of the words of one text, A-Z lower-cased. Long
    texts are hashed in segments cut at separators."""
    import numpy as np

    low, gap = tables()
    buf = np.frombuffer(data, dtype=np.uint8)
    parts, at = [], 0
    while at < len(buf):
        end = min(len(buf), at + SEGMENT)
        while end < len(buf) and not gap[buf[end]]:
            end += 1
        s, e, h = _segment_words(buf[at:end], low, gap)
        parts.append((s + at, e + at, h))
        at = end
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def batch_words(texts: list[bytes]):
    """Word hashes of many texts in one array, and the place where each text's words begin
    (one more entry for the end)."""
    import numpy as np

    low, gap = tables()
    hashes, bounds, at = [], [0], 0
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size == 0 or size + len(texts[j]) < SEGMENT):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1 and size > SEGMENT:
            h = words(texts[i])[2]
            hashes.append(h)
            bounds.append(bounds[-1] + len(h))
        else:
            joined = np.frombuffer(b" ".join(texts[i:j]) + b" ", dtype=np.uint8)
            s, _, h = _segment_words(joined, low, gap)
            cuts = np.cumsum([len(t) + 1 for t in texts[i:j]])
            counts = np.searchsorted(s, cuts)
            hashes.append(h)
            bounds.extend((bounds[-1] + counts).tolist())
        i = j
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(bounds, dtype=np.int64)


def sequences(h, n: int):
    """Hashes of every ``n`` words in a row, over an array of word hashes."""
    import numpy as np

    count = len(h) - n + 1
    if count <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0xF1357AEA2E62A9C5) + h[i:i + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def sliding_min(keys, width: int):
    """Least value of every ``width`` values in a row."""
    import numpy as np

    n = len(keys)
    padded = np.full(-(-n // width) * width + width, ~np.uint64(0))
    padded[:n] = keys
    block = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])
