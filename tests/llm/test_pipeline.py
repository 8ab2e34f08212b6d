"""The whole pipeline against a brute-force version on a small corpus."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
from test_operators import PATTERN, WORD, jaccard_brute, lines_brute, lower, quality_brute

from docspark.llm.quality_rules import RULES

SYLLABLES = "ka lo mi ne pu ra si to vu we xa yo zi be du".split()


def corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4)))
    line = lambda: " ".join(word() for _ in range(rnd.randint(8, 20)))
    bench = [(i, " ".join(word() for _ in range(14))) for i in range(6)] + [(9, None)]
    docs, shared = [], [line() for _ in range(3)]
    for i in range(90):
        lines = [line() for _ in range(rnd.randint(2, 8))]
        if i % 7 == 0:
            lines.insert(1, rnd.choice(shared))
        if i % 9 == 4:
            lines.append(bench[i % 6][1] + " " + line())
        text = "\n".join(lines)
        if i % 10 == 5 and docs:
            words = docs[-1][1].replace("\n", " ").split(" ")
            words[3] = word()
            text = " ".join(words)
        if i % 11 == 6:
            text = docs[rnd.randrange(len(docs))][1]
        if i % 13 == 7:
            text = "bad!! " * 40
        docs.append((i, text, "en", f"s{i % 3}" if i % 8 else None, len(text)))
    docs += [(200, None, "en", "s0", 0), (201, "", "en", "s0", 0), (202, bench[0][1] + " " + bench[1][1], "en", "s1", 9)]
    return docs, bench


def brute(docs, bench):
    def fails(text):
        n, chars, symbols, _, repeat = quality_brute(text)
        w, text = WORD.findall(text or ""), text or ""
        lines = [x for x in text.split("\n") if WORD.search(x)]
        names = dict(
            n_words=n, word_chars=chars, n_symbols=symbols, n_repeat_words=repeat, n_lines=len(lines),
            n_dup_lines=len(lines) - len(set(lines)), n_exclamations=text.count("!"),
            n_upper=len(re.findall("[A-Z]", text)), n_stutters=sum(a == b for a, b in zip(w, w[1:])))
        return any(eval(r.fails.replace("OR", "or"), {}, names) for r in RULES)

    docs = [d for d in docs if not fails(d[1])]
    report = {r[0]: r for r in lines_brute(docs)}
    owners = {}
    for d in docs:
        for x in d[1].split("\n"):
            owners.setdefault(lower(x.strip(" \t\n\x0b\x0c\r")), set()).add(d[0])
    kept = []
    for d in docs:
        lines = [x for x in d[1].split("\n") if len(k := lower(x.strip(" \t\n\x0b\x0c\r"))) < 10 or min(owners[k]) == d[0]]
        text = "\n".join(lines)
        assert hashlib.sha256(text.encode()).hexdigest() == report[d[0]][3]
        kept.append((d[0], text, d[2], d[3]))
    groups = jaccard_brute(kept, 5, 80, 100)
    stay = {g[0] for g in groups if g[0] == g[2]}
    kept = [d for d in kept if d[0] in stay]
    windows = set()
    for _, text in bench:
        w = PATTERN.findall(lower(text))
        windows |= {tuple(w[i:i + 10]) for i in range(len(w) - 9)}
    clean = []
    for d in kept:
        text, drop = d[1], False
        while True:
            spans = [m.span() for m in PATTERN.finditer(lower(text))]
            w = [lower(text)[a:b] for a, b in spans]
            hit = sorted({j for i in range(len(w) - 9) if tuple(w[i:i + 10]) in windows for j in range(i, i + 10)})
            if not hit:
                break
            if len(hit) > 0.5 * len(w):
                drop = True
                break
            runs, at, out = [], 0, ""
            for j in hit:
                if runs and runs[-1][1] == j - 1:
                    runs[-1][1] = j
                else:
                    runs.append([j, j])
            for a, b in runs:
                out, at = out + text[at:spans[a][0]], spans[b][1]
            text = out + text[at:]
        if not drop:
            clean.append((d[0], text, d[3]))
    return clean


def test_pipeline(spark, tmp_path):
    docs, bench = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    want = {d[0]: d for d in brute(docs, bench)}
    assert set(got) == set(want) and 0 < len(want) < len(docs)
    sizes, taken, target = Counter(), Counter(), {}
    for doc, (_, text, source) in want.items():
        assert got[doc].size == len(WORD.findall(text)) and got[doc].source == source
        sizes[source] += got[doc].size
        taken[source] += got[doc].taken
        target[source] = got[doc].target
        assert 0 <= got[doc].taken <= 3 * got[doc].size
    assert sum(taken.values()) == sum(sizes.values()) or all(t <= 3 * sizes[s] for s, t in target.items())
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 1


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    docs, bench = corpus()
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], kind)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0, name
