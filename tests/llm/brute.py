"""The contracts by brute force, in plain Python: slow, short, and without the operators' own code."""

import hashlib
import math
import re
import unicodedata
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def shingles(text):
    w = words("".join(x.lower() if "A" <= x <= "Z" else x for x in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def classes(rows):
    """For each row (doc_id, text): number of shingles, component_id, and the rows of its component."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_set = defaultdict(list)
    for i, s in enumerate(sets):
        by_set[frozenset(s)].append(i)
    firsts = [m[0] for s, m in by_set.items() if s]
    for members in (m for s, m in by_set.items() if s):
        for i in members:
            root[i] = members[0]
    for n, a in enumerate(firsts):
        for b in firsts[n + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 100 * small >= 75 * large:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * (small + large - both):
                    root[find(b)] = find(a)
    groups = defaultdict(list)
    for i, s in enumerate(sets):
        groups[find(i) if s else ("alone", i)].append(i)
    out = [None] * len(rows)
    for members in groups.values():
        known = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = len(sets[i]), min(known) if known else None, members
    return out


def removed(rows, window=13):
    """For each row (doc_id, text): n_words, n_removed, kept_sha256."""
    starts = defaultdict(set)
    split = [words(t) for _, t in rows]
    for (doc, _), w in zip(rows, split):
        if doc is not None:
            for i in range(len(w) - window + 1):
                starts[tuple(w[i : i + window])].add(doc)
    first = {k: min(v) for k, v in starts.items()}
    out = []
    for (doc, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - window + 1):
            least = first.get(tuple(w[i : i + window]))
            if least is not None and (doc is None or least < doc):
                gone.update(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


# Personal data


def luhn(digits):
    odd = [int(x) for x in digits[-1::-2]]
    even = [sum(divmod(2 * int(x), 10)) for x in digits[-2::-2]]
    return (sum(odd) + sum(even)) % 10 == 0


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def further_spans(text, lengths, context, counter, reach=40):
    """Account numbers, identity numbers and local phones that reach 0.7, none over a base span."""

    def near(names, a, b):
        return any(re.fullmatch(re.escape(n), text[i : i + len(n)], re.I) for n in names for i in range(max(0, a), min(b, len(text)))
                   if (i == 0 or not re.match(r"\w", text[i - 1])) and not re.match(r"\w", text[i + len(n) :]))

    found, i = [], 0
    while i < len(text):
        size = lengths.get(text[i : i + 2])
        end = None
        if size and not re.match("[A-Za-z0-9]", text[i - 1 : i] if i else ""):
            at, signs, spaces = i, "", 0
            while at < len(text) and len(signs) < size and (re.match("[A-Z0-9]", text[at]) or text[at] == " " and not spaces and len(signs) >= 4):
                spaces = text[at] == " "
                signs += "" if spaces else text[at]
                at += 1
            if len(signs) == size and signs[2:4].isdigit() and not re.match("[A-Za-z0-9]", text[at:]):
                if int("".join(str(int(x, 36)) for x in signs[4:] + signs[:4])) % 97 == 1:
                    end = at
                    found.append(("iban", i, at, 0.8))
        i = end or i + 1
    found += [("national_id", *m.span(), 0.4) for m in re.finditer(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", text)]
    found += [("phone_local", *m.span(), 0.4) for m in re.finditer(r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])", text)]
    base = base_spans(text)
    out = []
    for kind, a, b, score in found:
        score += 0.35 * (near(context[kind], a - reach, a) or near(context[kind], b, b + reach)) - 0.3 * near(counter, a - reach, a)
        if score >= 0.7 - 1e-9 and not any(a < e and s < b for _, s, e in base):
            out.append((kind, a, b))
    return out


# Quality rules


def features(text, function_words):
    text = text or ""
    w, seen, places = words(text), defaultdict(list), set()
    for i in range(len(w) - 4):
        seen[tuple(w[i : i + 5])].append(i)
    for at in seen.values():
        if len(at) > 1:
            places.update(p for i in at for p in range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    kinds = Counter(unicodedata.category(x) for x in text)
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(places), "n_lines": len(lines), "runs": len(re.findall(r"[#*$%&|<>]+", text)),
        "letters": sum(n for k, n in kinds.items() if k[0] == "L"), "capitals": kinds["Lu"], "function": sum(x.lower() in function_words for x in w),
    }


def votes(f):
    n, empty = f["n_words"], not f["n_words"]
    per = lambda k: f[k] / max(n, 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    letters, capitals, dup = f["letters"] / max(f["word_chars"], 1), f["capitals"] / max(f["letters"], 1), f["n_dup_lines"] / max(f["n_lines"], 1)
    return (
        vote(n < 10, n >= 30), vote(per("word_chars") < 2 or per("word_chars") > 15, 3 <= per("word_chars") <= 10), vote(empty or per("n_symbols") > 0.2, per("n_symbols") < 0.02),
        vote(empty or per("runs") > 0.15, per("runs") < 0.02), vote(empty or letters < 0.7, letters > 0.85), vote(n >= 10 and capitals > 0.5, n > 0 and capitals < 0.2),
        vote(empty or per("n_repeat_words") > 0.2, per("n_repeat_words") < 0.05), vote(empty or dup > 0.3, dup < 0.1), vote(False, per("function") > 0.05),
    )


def posteriors(rows, rounds=50):
    """Of good quality, for rows of votes, by expectation-maximisation row by row."""
    width = len(rows[0])
    good, bad, prior = [[0.02, 0.18, 0.8] for _ in range(width)], [[0.4, 0.3, 0.3] for _ in range(width)], 0.85

    def each():
        for v in rows:
            x = math.log(prior) + sum(math.log(good[j][v[j] + 1]) for j in range(width))
            y = math.log(1 - prior) + sum(math.log(bad[j][v[j] + 1]) for j in range(width))
            yield 1 / (1 + math.exp(min(700, y - x)))

    for _ in range(rounds):
        p = list(each())
        for j in range(width):
            g = [s + sum(q for q, v in zip(p, rows) if v[j] == k - 1) for k, s in enumerate((0.5, 1, 1))]
            b = [1 + sum(1 - q for q, v in zip(p, rows) if v[j] == k - 1) for k in range(3)]
            g, b = [x / sum(g) for x in g], [x / sum(b) for x in b]
            if g[0] > 0.1:
                g = [0.1, *[x * 0.9 / (1 - g[0]) for x in g[1:]]]
            if b[0] < 2 * g[0]:
                b = [2 * g[0], *[x * (1 - 2 * g[0]) / (1 - b[0]) for x in b[1:]]]
            good[j], bad[j] = g, b
        prior = min(0.98, max(0.5, sum(p) / len(p)))
    return list(each())


# Mixing


def targets(sizes, weights=(5, 2, 1), most=3):
    """By source, null last: water poured until all of it is shared or every source is full."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, open_ = {s: 0.0 for s in order}, float(sum(sizes.values())), {s for s in order if sizes[s]}
    while open_ and left > 1e-9:
        whole = sum(weight[s] for s in open_)
        step = min(left / whole, min((most * sizes[s] - out[s]) / weight[s] for s in open_))
        for s in open_:
            out[s] += step * weight[s]
        left -= step * whole
        open_ = {s for s in open_ if most * sizes[s] - out[s] > 1e-9}
    return out


def taken(rows, seed=8):
    """For each row (doc_id, text, source): size, source_size, target, words taken."""
    size, by_source = [len(words(t)) for _, t, _ in rows], defaultdict(list)
    for i, (_, _, source) in enumerate(rows):
        by_source[source].append(i)
    whole = {s: sum(size[i] for i in m) for s, m in by_source.items()}
    target, out = targets(whole), [None] * len(rows)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda d, t: int(md5(f"{seed}-" + (str(d) if d is not None else "null-" + md5(t or "")))[:10], 16)
    for source, members in by_source.items():
        times = int(target[source] // whole[source]) if whole[source] else 0
        rest = round(target[source] - times * whole[source])
        for i in sorted(members, key=lambda i: (place(rows[i][0], rows[i][1]), rows[i][0] is not None, rows[i][0] or 0, size[i])):
            extra = max(0, min(size[i], rest))
            rest -= extra
            out[i] = size[i], whole[source], target[source], times * size[i] + extra
    return out


def removed_bytes(rows, window=50):
    """For each row (doc_id, text): n_bytes, n_removed, n_spans, kept bytes."""
    least, raws = {}, [(doc, (text or "").encode()) for doc, text in rows]
    for doc, raw in raws:
        if doc is not None:
            for i in range(len(raw) - window + 1):
                w = raw[i : i + window]
                least[w] = min(least.get(w, doc), doc)
    out = []
    for doc, raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            first = least.get(raw[i : i + window])
            if first is not None and (doc is None or first < doc):
                gone[i : i + window] = [True] * window
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def runs_of(w, least_length=6, times=4):
    """(start, length, period) of every run of the words ``w``, and the words that are left."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_length, times * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    runs = sorted((s, n, q) for (s, n), q in found.items())
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return runs, [x for i, x in enumerate(w) if i not in gone]


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants(counts, times=5):
    """For each word of ``counts``: form, root, n, n_near, form_n."""
    near = {a: [b for b in counts if one_edit(a, b)] for a in counts}
    form = {}
    for a, others in near.items():
        if others:
            best = min(others, key=lambda b: (-counts[b], b))
            if counts[best] >= times * counts[a]:
                form[a] = best

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {a: (form.get(a), root(a), counts[a], len(near[a]), counts[form[a]] if a in form else None) for a in counts}


def repeated(rows, seed=8):
    """For each row (doc_id, text, source) how often the mix has it whole: the last one drawn counts if at least half of it is wanted."""
    size, by_source = [len(words(t)) for _, t, _ in rows], defaultdict(list)
    for i, (_, _, source) in enumerate(rows):
        by_source[source].append(i)
    whole = {s: sum(size[i] for i in m) for s, m in by_source.items()}
    target, out = targets(whole), [0] * len(rows)
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    place = lambda d, t: int(md5(f"{seed}-" + (str(d) if d is not None else "null-" + md5(t or "")))[:10], 16)
    for source, members in by_source.items():
        if whole[source]:
            times = int(target[source] // whole[source])
            rest = round(target[source] - times * whole[source])
            for i in sorted(members, key=lambda i: (place(rows[i][0], rows[i][1]), rows[i][0] is not None, rows[i][0] or 0, size[i])):
                part = max(0, min(size[i], rest))
                rest -= size[i]
                out[i] = times + (2 * part >= size[i]) if size[i] else 0
    return out
