"""Plain versions of what the corpus operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash
from tokenizers import Tokenizer


def roots(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def token_ids(texts, end=True):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*x.ids, *([1] if end else [])] for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", fold(text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(rows):
    """(doc_id, hex fingerprint, component) of (doc_id, text) rows."""
    fps = [fingerprint(t) for _, t in rows]
    a = np.asarray(fps, np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(a[:, None] ^ a[None, :]) <= 2, 1))
    root = roots(len(rows), zip(i.tolist(), j.tolist()))
    least = {}
    for r, (d, _) in zip(root, rows):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{f:016x}", least.get(r)) for (d, _), f, r in zip(rows, fps, root)]


def exact(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(fold(t), []).append(d)
    out = []
    for d, t in rows:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), hashlib.sha256(fold(t).encode()).hexdigest()))
    return out


def pieces(texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = []
    for t in texts:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        out.append((len(ids), hashlib.sha256(np.asarray(ids, "<u4").tobytes()).hexdigest(),
                    hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return out


def chats(rows):
    """Digests of (conv_id, turn, role, text) rows, without the formatted length."""
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in groups.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[c] = (len(turns), sha(whole), len(loss), sha(loss))
    return out


def vectors(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector, label) rows."""
    links = []

    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if good(v) else None for _, v, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and unit[i] is not None and unit[j] is not None:
                if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                    links.append((i, j))
    root = roots(len(rows), links)
    n = np.bincount([x for p in links for x in p], minlength=len(rows)) if links else [0] * len(rows)
    least = {}
    for r, (v, _, _) in zip(root, rows):
        if v is not None:
            least[r] = min(v, least.get(r, v))
    return [(v, int(k), least.get(r), v is not None and v == least.get(r)) for (v, _, _), k, r in zip(rows, n, root)]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def line_hash(line):
    words = set(line.split(" "))
    hashes = [xxhash.xxh64(w.encode()).intdigest() for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def lines(rows, similarity=0.8, bits=3):
    """(doc_id, line_no, kept) of (doc_id, text) rows with distinct doc_ids."""
    places, norms = [], []
    for d, t in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate((t or "").split("\n")):
            places.append((d, i))
            norms.append(" ".join(re.findall("[^\x20\x09-\x0d]+", fold(line))))
    distinct = sorted({n for n in norms if n})
    fps = np.asarray([line_hash(n) for n in distinct], np.uint64)
    i, j = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= bits, 1)) if len(fps) else ([], [])
    links = [(a, b) for a, b in zip(i, j) if edit_distance(distinct[a], distinct[b]) <=
             int((1 - similarity) * max(len(distinct[a]), len(distinct[b])) + 1e-9)]
    root = dict(zip(distinct, roots(len(distinct), links)))
    seen, out = set(), []
    for place, n in zip(places, norms):
        out.append((*place, not n or root[n] not in seen))
        seen.add(root.get(n))
    return out
