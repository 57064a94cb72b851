"""Plain versions of the operators, and awkward documents to try them on."""

from __future__ import annotations

import collections
import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, key string, point string, kind string, group string, bin long, words string, label string"


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def awkward(spark, seed: int = 0):
    """Nulls in every column, empty and long texts, ties, repeated rows, other
    scripts, control characters, special strings and columns with clashing names."""
    rnd = random.Random(seed)
    base = "The quick brown fox, it's 42 years old & jumps over the lazy dog. "
    texts = [
        None, "", " ", "\n\n", "a", "é", base * 40, base * 40, base * 39 + "end", "x" * 5000, "ab" * 3000, "<|endoftext|> and <|startoftext|>", "token ▁ mark  two   spaces \n line",
        "İstanbul ǅ ﬁ naïve 日本語 テスト 한국어 🙂🙂 ½²", "\x00\x01 tab\tvt\x0bff\x0c nbsp\xa0 end\r\n", "é combining", "mail me@example.com or +1 (555) 123-4567, 10.1.2.3, 4111 1111 1111 1111", "  lead and trail  ",
        "\n".join(["same line here"] * 9), " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 9) for _ in range(4000)), "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN " * 3,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t) if t else None, "k", "p", None, "g", i, "w", "l") for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, "no id " * 60, *[None] * 10), (None, "no id " * 60, *[None] * 10), (3, "other text with an id that repeats", *[None] * 10)]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, AWKWARD).repartition(3)


def pairs(df) -> list[tuple]:
    return [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]


def removed(rows: list[tuple], length: int) -> list[tuple]:
    data = [(i, t.encode()) for i, t in rows]
    count = collections.Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, sha(bytes(x for x, y in zip(b, gone, strict=True) if not y))))
    return sorted(out, key=str)


def shingles(text: str, n: int) -> set:
    w = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    k = min(n, len(w))
    return {tuple(w[j : j + k]) + (() if len(w) >= n else (len(w),)) for j in range(len(w) - k + 1)} if w else set()


def linked(rows: list[tuple], n: int, a: int, b: int) -> list[tuple]:
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            both = len(x & sets[j])
            if both and b * both >= a * (len(x) + len(sets[j]) - both):
                parent[root(j)] = root(i)
    low: dict[int, int] = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted([(d, len(sets[i]), low.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)], key=str)


def base_rules(t: str) -> tuple:
    w = WORD.findall(t)
    n, lines = len(w), [x for x in t.split("\n") if WORD.search(x)]
    at = collections.defaultdict(list)
    for i in range(n - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), n < 20 or 100 * len(covered) > 30 * n


def personal(t: str, luhn) -> list[tuple]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
