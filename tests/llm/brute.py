"""Plain-Python versions of the operators' contracts."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low_words(text):
    return (text or "").encode().lower().split()


def quality(text):
    text = text or ""
    w, lines = words(text), [x for x in text.split("\n") if words(x)]
    seen, covered = defaultdict(list), set()
    for i in range(len(w) - 7):
        seen[tuple(w[i:i + 8])].append(i)
    for places in seen.values():
        if len(places) > 1:
            for i in places:
                covered.update(range(i, i + 8))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def quality_features(text):
    w = words(text)
    return [*w, *zip(w, w[1:]), *(("four", text[i:i + 4]) for i in range(len(text) - 3))]


def _passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d)))
        return 14 <= len(d) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(d) <= 15


def pii(text):
    spans = sorted((m.start(), i, m.end(), k) for i, k in enumerate(PII) for m in re.finditer(PII[k], text or "") if _passes(k, m.group()))
    written = ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)
    return tuple(sum(s[1] == i for s in spans) for i in range(4)) + (hashlib.sha256(written.encode()).hexdigest(),)


def classes(docs, width, percent):
    """{doc_id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {}
    for d, t in docs:
        w = low_words(t)
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def unigrams_and_ppm(docs, order=3):
    """{doc_id: (held_out, n_tokens, n_known, N, base_score, score)}."""
    counts, levels = Counter(), [defaultdict(Counter) for _ in range(order + 1)]

    def raw(t):
        return b"\xfe" * order + (t or "").encode().lower() + b"\xff"

    for d, t in docs:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update([*low_words(t), None])
            b = raw(t)
            for i in range(order, len(b)):
                for k in range(order + 1):
                    levels[k][b[i - k:i]][b[i]] += 1
    n, v, out = sum(counts.values()), len(counts), {}
    for d, t in docs:
        tokens, b, s = [*low_words(t), None], raw(t), 0.0
        for i in range(order, len(b)):
            gone = set()
            for k in range(order, -1, -1):
                left = {x: c for x, c in levels[k].get(b[i - k:i], {}).items() if x not in gone}
                if not left:
                    continue
                total = sum(left.values()) + len(left)
                if b[i] in left:
                    s += math.log10(left[b[i]] / total)
                    break
                s += math.log10(len(left) / total)
                gone |= set(left)
            else:
                s -= math.log10(max(1, 256 - len(gone)))
        out[d] = (zlib.crc32(str(d).encode()) % 7 == 2, len(tokens), sum(counts[x] > 0 for x in tokens), n,
                  sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens), s)
    return out


def _low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def importance(docs, target, buckets=10_000, percent=25, least=20):
    """{doc_id: (n_features, weight, score, rank)}"""
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _low(text))
        return w, [zlib.crc32(x.encode()) % buckets for x in [*w, *map(" ".join, zip(w, w[1:]))]]

    all_docs = [(d, *found(t)) for d, t in docs]
    s, t = Counter(b for _, _, bs in all_docs for b in bs), Counter(b for x in target for b in found(x)[1])
    big_s, big_t = float(sum(s.values())) + buckets, float(sum(t.values())) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in s}
    out, able = {}, []
    for i, (d, w, bs) in enumerate(all_docs):
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs) // len(bs) if bs else 0
        out[i] = [d, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if len(w) >= least:
            able.append(i)
    able.sort(key=lambda i: (-out[i][3], out[i][0] is None, out[i][0]))
    for place, i in enumerate(able[:percent * len(able) // 100]):
        out[i][4] = place + 1
    return sorted(map(tuple, out.values()), key=str)


def phrases(docs, support=30, first=2000):
    """Rows (lang, rank, phrase, a, l, r, n, score) from docs(lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", _low(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    many = {x: a for x, a in f.items() if a >= support}
    dropped = {(lang, w[i:i + m]) for (lang, w), a in many.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
               if 100 * a >= 80 * f[lang, w[i:i + m]]}
    out = defaultdict(list)
    for (lang, w), a in many.items():
        if len(w) > 1 and (lang, w) not in dropped:
            score, _, left, right = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -score) for lang, rows in out.items()
                  for i, (score, a, p, left, right) in enumerate(sorted(rows)[:first]))


def terms(rows, spans_of, letters=4, prior=1.0, disclosure=0.7):
    """{text: set of disclosing words} by the definition; spans_of(text): (start, end) of the pattern spans."""
    texts = {t or "" for _, t in rows}
    found, words_of = {}, {}
    for t in texts:
        chars = list(t)
        for a, b in spans_of(t):
            chars[a:b] = "\ue002" * (b - a)
        found[t] = {t[a:b].lower() for a, b in spans_of(t)}
        words_of[t] = {w.lower() for w in re.findall(r"[^\W\d_]+", "".join(chars)) if len(w) >= letters}
    n, n_t, n_e, n_te = len(texts), Counter(), Counter(), Counter()
    for t in texts:
        n_t.update(words_of[t]), n_e.update(found[t]), n_te.update((w, e) for w in words_of[t] for e in found[t])
    out = {}
    for t in texts:
        out[t] = {w for w in words_of[t] for e in found[t] if n > n_e[e] and math.log(
            (n_te[w, e] + prior * n_e[e] / n) / (n_t[w] + prior) * n / n_e[e]) >= disclosure * math.log(n / n_e[e])}
    return out


def url_tokens(url):
    found = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda m: m[0].lower(), found[1]), found[2]) if found else ("", "")
    parts = [x for x in host.split(".") if x]
    out = {f"host {x}" for x in parts} | {f"part {y}" for x in parts if "-" in x for y in x.split("-")}
    out |= {f"path {x}" for x in path.split("/") if x and not re.fullmatch("[0-9]+", x)} | {f"key {k}" for k in re.findall(r"[?&]([^=&#]+)", url or "")}
    suffix = re.search(r"\.([A-Za-z]+)$", path)
    return frozenset(out | ({f"file {suffix[1].lower()}"} if suffix else set()))


def url_verdicts(urls, labelled, least=5, floor=0.5, z=1.28):
    """{url: verdict or None} by every combination of tokens of labelled [(url, label)]."""
    def subsets(tokens):
        tokens = sorted(tokens)
        return [tuple(t for i, t in enumerate(tokens) if bits >> i & 1) for bits in range(1, 1 << len(tokens))]

    n, k, of = Counter(), Counter(), Counter(label for _, label in labelled)
    for url, label in labelled:
        for s in subsets(url_tokens(url)):
            n[s] += 1
            k[s, label] += 1
    rules = {}
    for (s, label), a in k.items():
        p, m = a / n[s], n[s]
        bound = (p + z * z / (2 * m) - z * math.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        if a >= least and bound >= floor and bound > of[label] / len(labelled):
            rules[s, label] = bound
    kept = {(s, label): b for (s, label), b in rules.items() if not any(rules.get((t, label), 0) >= b for t in subsets(s) if t != s)}
    out = {}
    for url in urls:
        tokens = url_tokens(url)
        fit = [(-b, -n[s], len(s), list(s), label) for (s, label), b in kept.items() if set(s) <= tokens]
        out[url] = min(fit)[4] if fit else None
    return out
