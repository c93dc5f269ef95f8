"""Plain-Python results of the corpus operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

BLANK = "[\x20\x09-\x0d]"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """rows: (doc_id, text) -> (doc_id, keep_id, group_size, kept, text_sha256)."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(BLANK, "", t or "")].append((-len(t or ""), i))
    return sorted((i, min(groups[n := re.sub(BLANK, "", t or "")])[1], len(groups[n]),
                   min(groups[n])[1] == i, sha(n)) for i, t in rows)


def lines(rows, least):
    """rows: (doc_id, text) -> (doc_id, n_lines, n_dropped, kept_sha256)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def key(line):
        return re.sub(f"^{BLANK}+|{BLANK}+$", "", line).translate(low)

    split = [(i, (t or "").split("\n")) for i, t in rows]
    found = Counter(k for _, ls in split for k in {key(x) for x in ls})
    out = []
    for i, ls in split:
        kept = [x for x in ls if not key(x) or found[key(x)] < least]
        out.append((i, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return sorted(out)


def shingle_set(text, words):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(low))
    n = min(words, len(found))
    return {tuple(found[i:i + n]) for i in range(len(found) - n + 1)} if n else set()


def near(rows, words, percent):
    """rows: (doc_id, text) -> (doc_id, n_shingles, component_id, kept)."""
    sets = [(i, shingle_set(t, words)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for at, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(at)
    for at, (i, s) in enumerate(sets):
        shared = Counter(o for x in s for o in holders[x] if o > at)
        for o, both in shared.items():
            j, other = sets[o]
            if 100 * both >= percent * (len(s) + len(other) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def tokens(rows):
    """rows: (doc_id, text) -> (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), sha(",".join(map(str, ids))),
                    sha(t.decode(ids, skip_special_tokens=False))))
    return sorted(out)


def spelling(rows):
    """rows: (doc_id, text) -> (word, form, root, n, n_near, form_n)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(low)
            h = zlib.crc32(f"{'null' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            found[run] += 1
    n = {w: c for w, c in found.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(set)
    gaps = defaultdict(list)
    for w in n:
        for p in range(len(w)):
            shorter = w[:p] + w[p + 1:]
            gaps[p, shorter].append(w)
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in gaps.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, c in n.items():
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * c else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), c, len(near[w]), n.get(form[w])) for w, c in n.items())


def phrases(rows, least, top):
    """rows: (lang, text) -> (lang, rank, phrase, a, l, r, n, score)."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in (1, 2, 3, 4):
                counts[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(longer[p[i:i + k]], a)
        scored = []
        for p, a in found.items():
            if 100 * longer[p] < 80 * a:
                score, _, l, r = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]])
                                     for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s)
                for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)
