"""Plain Python versions of the operators' contracts, for small fixtures."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def op1(docs, window=13):
    first = {}
    for i, t in sorted(((i, t) for i, t in docs if i is not None), key=lambda x: x[0]):
        w = WORD.findall(t or "")
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j:j + window]), i)
    out = []
    for i, t in docs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if i is not None and first[tuple(w[j:j + window])] < i:
                gone[j:j + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def op4(docs, window=50):
    first = {}
    for i, t in sorted(((i, t) for i, t in docs if i is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for j in range(len(b) - window + 1):
            first.setdefault(b[j:j + window], i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - window + 1):
            if i is not None and first[b[j:j + window]] < i:
                gone[j:j + window] = True
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, sha(np.frombuffer(b, np.uint8)[~gone].tobytes())))
    return out


def op2_base(text):
    t = text or ""
    w = WORD.findall(t)
    seen = {}
    for j in range(len(w) - 4):
        seen.setdefault(tuple(w[j:j + 5]), []).append(j)
    covered = {j + k for at in seen.values() if len(at) > 1 for j in at for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            len(w) < 10 or 100 * len(covered) > 20 * len(w))


def fingerprint(text, shingle=3):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return 0
    shingles = [" ".join(w[j:j + shingle]) for j in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def op3(docs, radius=2):
    fps = [fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        r = find(k)
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    return [(i, f"{fps[k]:016x}", least[find(k)]) for k, (i, _) in enumerate(docs)]


def op7(docs, benchmark, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = {}
    for item, t in benchmark:
        w = word.findall((t or "").translate(LOWER))
        for j in range(max(len(w) - window + 1, 1 if w else 0)):
            patterns.setdefault(tuple(w[j:j + window]), set()).add(str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for i, t in docs:
        w = word.findall((t or "").translate(LOWER))
        hit, items = set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                found = patterns.get(tuple(w[j:j + n]))
                if found:
                    hit |= set(range(j, j + n))
                    items |= found
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def op10_base(text):
    t = text or ""
    spans = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        spans.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 14 <= len(d) <= 19 and luhn(d):
            spans.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    names = ["email", "ip", "card", "phone"]
    spans.sort()
    return tuple(sum(s[1] == k for s in spans) for k in range(4)) + (
        sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in spans)),)


def check_packing(rows, texts, encode, size=1024):
    """Every id once, offsets gapless, sequences full or powers of two."""
    ids = {i: encode(t or "") + [0] for i, t in texts}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(ids)
    for i, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda r: r["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids[i]) and p["length"] > 0
            part = np.array(ids[i][at:at + p["length"]], "<u4").tobytes()
            assert zlib.crc32(part) == p["ids_crc32"]
            at += p["length"]
        assert at == len(ids[i])
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding


def op11(docs, seed=7, rate=100, first=50):
    out = []
    for i, t in docs:
        t = t or ""
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        h = sha(f"{seed}:{'' if i is None else i}")
        h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
        a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
        p, m, s = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
            out.append((i, len(lines), "plain", None, None, sha(t), sha(t)))
        elif h4 % 100 < first:
            out.append((i, len(lines), "spm", len(p), len(m), sha(f"<S>{s}<P>{p}<M>{m}"), sha(t)))
        else:
            out.append((i, len(lines), "psm", len(p), len(m), sha(f"<P>{p}<S>{s}<M>{m}"), sha(t)))
    return out


def op12(rows, every=100, positives=5, negatives=10):
    """rows: (vec_id, vector, label)."""
    taking = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and np.isfinite(x) for x in v):
            continue
        entry = ((label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
        taking[i] = min(taking.get(i, entry), entry)
    out = []
    for a, (label, v) in taking.items():
        if a % every:
            continue
        score = {i: sum(x * y for x, y in zip(v, w, strict=False)) for i, (_, w) in taking.items()}
        ranked = sorted((i for i in taking if i != a), key=lambda i: (-score[i], i))
        for p in [i for i in ranked if taking[i][0] == label][:positives]:
            hard = [i for i in ranked if taking[i][0] != label and 30 * score[p] <= 100 * score[i] <= 90 * score[p]]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(hard[:negatives])]
    return out


def op13(docs, shards=40, seed=13):
    """docs: (doc_id, text, source)."""
    by = {}
    for i, t, source in docs:
        t = t or ""
        name = f"{seed}:{'' if i is None else i}:{hashlib.md5(t.encode()).hexdigest()}"
        by.setdefault("" if source is None else "=" + source, []).append(
            (int(hashlib.md5(name.encode()).hexdigest()[:15], 16), -1 if i is None else i, i, t))
    order = []
    for stratum, members in by.items():
        for r, (h, key, i, t) in enumerate(sorted(members)):
            order.append(((2 * r + 1) / (2 * len(members)), stratum, h, key, i, t))
    n, used, out = len(order), [0] * shards, []
    for place, (*_, i, t) in enumerate(sorted(order, key=lambda x: x[:4])):
        shard = place * shards // n
        out.append((i, len(t.encode()) + 16, zlib.crc32(t.encode()), "rows", shard, used[shard], None))
        used[shard] += 1
    return out


def jaccard_groups(docs, size=5):
    """The smallest doc_id of every document's group."""
    found = []
    for i, text in docs:
        words = (text or "").encode().lower().split()
        found.append((i, {tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))}))
    root = {i: i for i, _ in found}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(found):
        for b, y in found[:k]:
            if len(x & y) * 5 >= 4 * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return {i: find(i) for i, _ in found}
