"""Plain Python versions of the operators' contracts."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall("[^\x20\x09-\x0d]+", lower(text))


def fold(key, n):
    return zlib.crc32(("" if key is None else str(key)).encode()) % n


def base_scores(docs):
    """{row: (held_out, n_tokens, n_known, N, base)} by place in docs."""
    tokens = [[*spaced(t), None] for _, t in docs]
    train = Counter(w for (k, _), ts in zip(docs, tokens) if fold(k, 7) != 2 for w in ts)
    n, v = sum(train.values()), len(train)
    return [
        (fold(k, 7) == 2, len(ts), sum(w in train for w in ts), n,
         sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ts))
        for (k, _), ts in zip(docs, tokens)
    ]


def fingerprint(text):
    words = spaced(text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(codes, most=2):
    """Least code of the component of each different code."""
    codes = np.array(sorted(set(codes)), dtype=np.uint64)
    label = {int(c): int(c) for c in codes}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for k, c in enumerate(codes):
        for other in codes[k + 1 :][np.bitwise_count(c ^ codes[k + 1 :]) <= most]:
            a, b = find(int(c)), find(int(other))
            label[max(a, b)] = min(a, b)
    return {int(c): find(int(c)) for c in codes}


def repeats(docs, size=100):
    """{key: (n_bytes, n_removed, n_spans, kept sha256)}; docs have different keys."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        data = (text or "").encode()
        gone, end = bytearray(len(data)), 0
        for p in range(len(data) - size + 1):
            if data[p : p + size] in seen:
                for q in range(max(p, end), p + size):
                    gone[q] = 1
                end = p + size
            else:
                seen.add(data[p : p + size])
        spans = sum(gone[k] and (k == 0 or not gone[k - 1]) for k in range(len(gone)))
        kept = bytes(x for x, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


ALNUM = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def matches(docs, items, size=10):
    """[(n_words, n_hit, n_items, sha256, contaminated)] by place in docs."""
    windows = defaultdict(set)
    for key, text in items:
        words = ALNUM.findall(lower(text))
        n = min(size, len(words))
        for k in range(len(words) - n + 1) if words else ():
            windows[tuple(words[k : k + n])].add(str(key))
    lengths, out = {len(w) for w in windows}, []
    for _, text in docs:
        words, hit, found = ALNUM.findall(lower(text)), set(), set()
        for n in lengths:
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(words[k : k + n])]
        names = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(words), len(hit), len(found), names, bool(hit)))
    return out


def nearest(vectors, every=20, most=20):
    """{query id: [(id, score)]} over (id, vector) rows."""
    out = {}
    for key, query in vectors:
        if key % every == 0:
            scores = [(float(np.dot(np.array(v), np.array(query))), k) for k, v in vectors if k != key]
            out[key] = [(k, s) for s, k in sorted(scores, key=lambda x: (-x[0], x[1]))[:most]]
    return out


def alignment(texts, byte_bpe, piece_bpe):
    """(n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each text, encoded whole."""
    import json

    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(byte_bpe)
    a.encode_special_tokens = True
    letters = {ch: k for k, ch in enumerate(_letters())}
    entries = {k: bytes(letters[c] for c in e) for e, k in json.load(open(byte_bpe))["model"]["vocab"].items() if all(c in letters for c in e)}
    b = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
    groups = []
    for text in texts:
        found, whole = [], (" " + (text or "")).encode()
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_bytes = [entries[k] for k in a_ids]
        b_bytes = [
            bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
            for p in map(b.id_to_piece, b_ids)
        ]
        if text and b"".join(a_bytes) == whole == b"".join(b_bytes):
            i = j = at_a = at_b = 0
            group = ([], [])
            while i < len(a_ids) or j < len(b_ids):
                if at_a <= at_b:
                    group[0].append(a_ids[i])
                    at_a, i = at_a + len(a_bytes[i]), i + 1
                else:
                    group[1].append(b_ids[j])
                    at_b, j = at_b + len(b_bytes[j]), j + 1
                if at_a == at_b:
                    found.append(group)
                    group = ([], [])
        groups.append(found)
    links = [Counter((x, y) for g in found for x in g[0] for y in g[1]) for found in groups]
    held = Counter(pair for one in links for pair in one)
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for found, one in zip(groups, links):
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in found)
        out.append((
            sum(len(g[0]) for g in found), sum(len(g[1]) for g in found), len(found), sum(one.values()),
            sum(n for p, n in one.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in one.items()),
            hashlib.sha256(text.encode()).hexdigest() if found else "",
        ))
    return out


def _letters():
    """The visible letter of each byte of a byte-level vocabulary, by the library's own splitter."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    later = iter(range(0x100, 0x200))
    return [chr(k) if k in seen else chr(next(later)) for k in range(256)]


def trie(turns):
    """Rows of the conversation trie from (conv_id, turn, role, text), node by node."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(rows)] for c, rows in own.items()}
    members = defaultdict(list)
    ending = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        whole = [*own.get(c - int(math.fmod(c, 100)), [])[:h], *own[c][h:]]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ending[tuple(whole)].append(c)
    children = Counter(path[:-1] for path in members if path)
    leaves, saved = Counter(), Counter()
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not children[path]
            saved[path[:d]] += (len(held) - 1) * (len(path[-1][1]) if path else 0)
    return [
        (held[0], len(path), members[path[:-1]][0] if path else None, len(held), children[path], leaves[path], saved[path],
         hashlib.sha256(",".join(map(str, ending[path])).encode()).hexdigest())
        for path, held in members.items()
    ]
