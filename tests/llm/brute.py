"""Plain versions of the operators, for comparison on small tables."""

import xxhash


def simhash(text):
    return simhashes(text, 1)[0]


def simhashes(text, parts=16):
    """A fingerprint for each part: the shingles' hashes as they are, then after splitmix64's steps."""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return [0] * parts
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    out, whole = [], (1 << 64) - 1
    for part in range(parts):
        mixed = []
        for h in hashes:
            if part:
                h = h + part * 0x9E3779B97F4A7C15 & whole
                h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & whole
                h = (h ^ h >> 27) * 0x94D049BB133111EB & whole
                h ^= h >> 31
            mixed.append(h)
        out.append(sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in mixed) > len(mixed)))
    return out


def components(ids, fps, bits=2):
    return components_of_parts(ids, [[f] for f in fps], bits)


def components_of_parts(ids, fps, bits=2):
    """Smallest id reachable for each row, by all pairs; a pair is linked in any part."""
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if any((x ^ y).bit_count() <= bits for x, y in zip(fps[i], fps[j])):
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(ids))]


def removed_words(docs, window):
    """Numbers of the words that a window seen earlier covers, for each id of (id, text) rows."""
    seen, gone = {}, {}
    words = {d: (t or "").encode().split() for d, t in docs}
    for d in sorted(words):
        gone[d] = set()
        for s in range(len(words[d]) - window + 1):
            key = tuple(words[d][s : s + window])
            if key in seen:
                gone[d] |= set(range(s, s + window))
            seen.setdefault(key, (d, s))
    return gone
