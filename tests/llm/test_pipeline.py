"""The pipeline's stages, each against brute force on its own input."""

from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_documents import WORD, brute_components, corpus, repeats


def table(spark, tmp_path, name, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return spark.read.parquet(f"{tmp_path}/{name}.parquet")


def test_stages(spark, tmp_path):
    seen, rows = set(), []
    for d, t, *_ in corpus(8, 80):
        if d is not None and d not in seen:
            seen.add(d)
            rows.append((d, t, "en", "src", len(t or "")))
    rows.append((None, "a text without an id " + " ".join(f"v{i}" for i in range(40)), "en", "src", None))
    docs = table(spark, tmp_path, "documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    table(spark, tmp_path, "labels", spark.createDataFrame([(d, 1, 0) for d in range(0, 90, 2)], "doc_id long, quality int, toxic int"))
    assert [f for _, f in pipeline.STAGES] == [pipeline.rules, pipeline.lines, pipeline.near_duplicates, pipeline.passages, pipeline.pack]
    columns = docs.columns
    read = lambda df: [tuple(r) for r in df.collect()]

    kept = table(spark, tmp_path, "s0", pipeline.rules(spark, docs, str(tmp_path)))
    base = {d for d, t, *_ in rows if len(w := WORD.findall(t or "")) >= 20 and 100 * repeats(w) <= 30 * len(w)}
    assert kept.columns == columns and {r[0] for r in read(kept)} == base and set(read(kept)) <= set(rows)

    own = read(kept)
    done = table(spark, tmp_path, "s1", pipeline.lines(spark, kept, str(tmp_path)))
    first, want = {}, Counter()
    held = lambda t: [i for i, x in enumerate(t.split("\n")) if WORD.search(x)]
    for d, t, *_ in own:
        lines, at = t.split("\n"), held(t)
        for k in range(len(at) - 1):
            if d is not None:
                key = lines[at[k]], lines[at[k + 1]]
                first[key] = min(first.get(key, (d, k)), (d, k))
    for d, t, *rest in own:
        lines, at = t.split("\n"), held(t)
        gone = {i for k in range(len(at) - 1) if d is not None and first[lines[at[k]], lines[at[k + 1]]] < (d, k) for i in at[k : k + 2]}
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if WORD.search(text):
            want[d, text, *rest[:2], len(text)] += 1
    assert Counter(read(done)) == want and len(want) < len(own) + 1

    own = read(done)
    left = table(spark, tmp_path, "s2", pipeline.near_duplicates(spark, done, str(tmp_path)))
    stays = {d for d, _, c in brute_components(own, 5, 80) if d is None or c == d}
    assert Counter(read(left)) == Counter(r for r in own if r[0] in stays) and len(stays) < len(own)

    own = read(left)
    cut = table(spark, tmp_path, "s3", pipeline.passages(spark, left, str(tmp_path)))
    first, want = {}, Counter()
    for d, t, *_ in own:
        w = WORD.findall(t)
        for i in range(len(w) - 12):
            if d is not None:
                first[tuple(w[i : i + 13])] = min(first.get(tuple(w[i : i + 13]), d), d)
    for d, t, *rest in own:
        w = WORD.findall(t)
        gone = {i + k for i in range(len(w) - 12) if d is not None and first[tuple(w[i : i + 13])] < d for k in range(13)}
        text = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if text:
            want[d, text, *rest[:2], len(text)] += 1
    assert Counter(read(cut)) == want and want != Counter(own)

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(library.encode(r[1], add_special_tokens=False).ids) + 1 for r in read(cut))
    assert sum(r.length for r in pipeline.pack(spark, cut, str(tmp_path)).collect()) == total
    assert sum(r.length for r in pipeline.run(spark, str(tmp_path)).collect()) == total
