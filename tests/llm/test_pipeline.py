import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece

import corpus_pipeline


def test_stages_chain_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, sf_dir), f"test{k}")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        if k < 2:
            assert 0 < docs.count() < rows
            rows = docs.count()
        if k == 2:
            assert docs.count() == rows
    assert set(docs.columns) == {"doc_id", "n_tokens", "ids", "round_trip"} and docs.where("not round_trip").count() == 0


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, spans string"
KEY = hashlib.sha1(b"key").hexdigest()


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to"]) if k % 4 == 0 else "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 8))) for k in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Null and repeated ids, repeated rows, near copies, secrets, empty texts, junk and a column whose name an operator uses."""
    base = prose(90, 1)
    texts = [prose(40 + k, 10 + k) for k in range(40)] + [base, base, base.replace(base.split()[5], "other", 1), f'{prose(50, 3)} token = "{KEY}"', None, "", "few words", "*** " * 60, prose(30, 5) + f"\npassword: {KEY}"]
    rows = [(None if k % 7 == 3 else k // 2 if k % 7 == 4 else k, t, "en", None if k % 11 == 0 else f"s{k % 3}", len(t or ""), "clash") for k, t in enumerate(texts)]
    rows += [rows[1], rows[1]]
    d = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/documents.parquet")
    return d, rows


def test_stages_on_odd_rows_against_brute_force(spark, odd):
    d, rows = odd
    docs = corpus_pipeline.table(spark, d, "documents")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = corpus_pipeline.cut(stage(spark, docs, d), f"odd{k}")
        seen.append(docs.collect())
    kept, single, clean, mixed, encoded = seen

    def good(text):
        words = (text or "").split()
        return len(words) >= 20 and sum(c in "#*$%&|<>" for c in text) <= 0.1 * len(words)

    plain = lambda some: Counter((r[0], r[1], r[3]) for r in some)
    assert plain(kept) == plain([r for r in rows if good(r[1])])

    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (r["text"].split() for r in kept)]
    head = {}
    for a, r in enumerate(kept):
        if r["doc_id"] is not None:
            linked = [s["doc_id"] for b, s in enumerate(kept) if s["doc_id"] is not None and 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])]
            head[r["doc_id"]] = min([*linked, head.get(r["doc_id"], r["doc_id"])])
    assert plain(single) == plain([r for r in kept if r["doc_id"] is None or head[r["doc_id"]] == r["doc_id"]])

    assert len(clean) == len(single) and sum(KEY in r["text"] for r in single) == 2 and not any(KEY in r["text"] for r in clean)
    assert plain([r for r in clean if "[SECRET]" not in r["text"]]) == plain([r for r in single if KEY not in r["text"]])
    assert all(r["n_chars"] == len(r["text"]) for r in clean)

    known = {(r["doc_id"], r["text"], r["source"]) for r in clean}
    assert {(r["doc_id"], r["text"], r["source"]) for r in mixed} <= known
    size, words = defaultdict(int), defaultdict(int)
    for some, total in ((clean, size), (mixed, words)):
        for r in some:
            total[r["source"]] += len(r["text"].split())
    assert all(words[s] <= 3 * size[s] + max(len(r["text"].split()) for r in clean) for s in size) and abs(sum(words.values()) - sum(size.values())) < 0.35 * sum(size.values())

    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.TOKENIZER)
    want = Counter((r["doc_id"], tuple(library.encode(r["text"]))) for r in mixed)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in encoded) == want and all(r["round_trip"] for r in encoded)


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
