"""The pipeline's stages against what each must keep of a small corpus, and its rows against plain tokenizing."""

import random
import zlib

import numpy as np

import corpus_pipeline
from streamatlas.llm.queries import tokenizer_file

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, piece int"


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    vocabulary = sorted({"".join(rng.choice("aeioulnrstmd") for _ in range(rng.randint(3, 7))) for _ in range(600)})
    write = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, toxic, gone = {}, [], [set(), set(), set()]
    for k in range(300):
        words = write(60)
        if k % 5 == 0:
            words[20:20] = ["nasty", "vilest"]
            toxic.append(k)
        texts[k] = " ".join(words)
    gone[0] = set(toxic)
    near = texts[1].split()
    near[50] = "changed"
    texts |= {400: texts[2], 401: " ".join(near), 402: texts[5]}
    gone[0].add(402)
    gone[1] = {400, 401}
    item = " ".join(write(40))
    texts |= {500: " ".join(write(30)) + " " + item + " " + " ".join(write(30)), 600: "write to ann.lee@example.org " + " ".join(write(30)), 601: None, 602: "", 603: " ".join(write(5000))}
    gone[2] = {500}
    docs = spark.createDataFrame([(k, t, "en", "web", 0, 1) for k, t in texts.items()] + [(None, "a row without an id", None, None, None, None), (None, texts[5], None, None, None, None)], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, int(k in toxic)) for k in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left, now = set(texts), spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(f"{tmp_path}/stage{k}")
        now = spark.read.parquet(f"{tmp_path}/stage{k}")
        left -= gone[k] if k < 3 else set()
        assert now.columns == docs.columns
        ids = [r.doc_id for r in now.select("doc_id").collect()]
        assert len(ids) == len(left) + 1 and set(ids) == left | {None}
    assert "ann.lee" not in now.where("doc_id = 600").first().text

    plain = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    found = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(found.doc_id.dropna()) == left and found.doc_id.isna().sum() == 1
    for d in left - {600}:
        ids = plain.encode(texts[d] or "", add_special_tokens=False).ids + [0]
        own = found[found.doc_id == d].sort_values("piece")
        assert own.length.sum() == len(ids)
        for _, r in own.iterrows():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[int(r.start) : int(r.start + r.length)], "<u4").tobytes())
    for _, own in found.groupby("sequence_id"):
        assert own.length.sum() <= 2048
