"""Every stage of the pipeline against brute force, on what run() hands to it."""

import random
import re

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _corpus():
    rng = random.Random(8)
    vocab = ["".join(rng.choice("aeioustrnl") for _ in range(6)) for _ in range(900)]
    words = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows, bad = {}, set()
    for i in range(240):
        own = words(80)
        if i % 4 == 0:
            own[9:11] = [rng.choice(["grobian", "schurke", "lump"]) for _ in range(2)]
            bad.add(i)
        rows[i] = own
    clean = [i for i in range(240) if i not in bad]
    passage = words(55)
    for n, i in enumerate(clean[:30]):
        if n % 3 == 0:
            rows[300 + n] = list(rows[i])  # exact copies, white space apart
        elif n % 3 == 1:
            rows[300 + n] = [*rows[i][:40], "nearly", *rows[i][41:]]
        else:
            rows[i][20:20] = passage
    texts = {i: ("\n " if 300 <= i and (i - 300) % 3 == 0 else " ").join(x) for i, x in rows.items()}
    return texts | {900: None, 901: "", 902: "<|endoftext|> one"}, bad


def _shingles(text):
    words = (text or "").lower().split()
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else {()}


def _without_near_copies(texts):
    sets, root = {i: _shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return {i: t for i, t in texts.items() if root[i] == i}


def _without_later_strings(texts, length=200):
    seen, out = set(), {}
    for i in sorted(texts):
        text, gone = texts[i] or "", set()
        for s in range(len(text) - length + 1):
            if text[s : s + length] in seen:
                gone.update(range(s, s + length))
            seen.add(text[s : s + length])
        out[i] = "".join(c for p, c in enumerate(text) if p not in gone) if gone else texts[i]
    return out


def test_stages_like_brute_force(spark, tmp_path, monkeypatch):
    texts, bad = _corpus()
    rows = [(i, t, "xx", "s", None if t is None else len(t)) for i, t in texts.items()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i in bad)) for i in range(240)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    handed = []

    def watched(stage):
        def run(spark, docs, sf_dir):
            handed.append((docs.columns, {r.doc_id: (r.text, r.n_chars) for r in docs.collect()}))
            return stage(spark, docs, sf_dir)

        return run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(f)) for n, f in corpus_pipeline.STAGES])
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(handed) == 5 and all(c == ["doc_id", "text", "lang", "source", "n_chars"] for c, _ in handed)
    given, civil, single, apart, cut = ({i: t for i, (t, _) in x.items()} for _, x in handed)
    assert given == texts
    assert len(bad & set(civil)) <= 0.05 * len(bad) and len(set(civil) - bad) >= 0.97 * (len(texts) - len(bad)) and civil.items() <= texts.items()

    first: dict = {}
    for i in sorted(civil):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", civil[i] or ""), i)
    assert single == {i: civil[i] for i in first.values()} and len(single) < len(civil)
    assert apart == _without_near_copies(single) and len(apart) < len(single)
    assert cut == _without_later_strings(apart) and cut != apart
    assert all(n == (None if t is None else len(t)) for t, n in handed[4][1].values())

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    want = {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in cut.items()}
    sequences: dict = {}
    got = dict.fromkeys(want, 0)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == sequences.get(p["sequence_id"], 0) and p["doc_tokens"] == want[p["doc_id"]]
        sequences[p["sequence_id"]] = p["offset"] + p["length"]
        got[p["doc_id"]] += p["length"]
    assert got == want and max(sequences.values()) <= 2048
