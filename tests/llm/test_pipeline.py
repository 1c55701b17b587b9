"""The pipeline, stage by stage, against plain loops over the rows that the stage before kept."""

import hashlib
import math
import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from test_exact_and_near import lower, plain_components, plain_print  # noqa: E402
from test_mixing_packing import check_pieces, plain_targets  # noqa: E402

import corpus_pipeline  # noqa: E402
from shelfmark.llm import toxicity  # noqa: E402
from shelfmark.llm.common import documents, land  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def plain_mix(data, seed=7):
    sizes = {}
    for r in data:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(r["text"].split())
    targets, out = plain_targets(sizes), []
    for source in sizes:
        own = sorted((len(r["text"].split()), r["doc_id"]) for r in data if r["source"] == source)
        rate = targets[source] / sizes[source]
        start = int(hashlib.md5(f"{seed}:{source}".encode()).hexdigest()[:8], 16) / 2 ** 32
        for k, (_, doc_id) in enumerate(own):
            out += [doc_id] * (math.floor((k + 1) * rate + start) - math.floor(k * rate + start))
    return sorted(out)


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    docs = documents(spark, FOLDER)
    columns = docs.columns
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(land(stage(spark, frames[-1], FOLDER), f"test-{name}"))
    for frame in frames[1:-1]:
        assert frame.columns == columns
    whole, civil, distinct, apart, mixed, pieces = [f.collect() for f in frames]

    machine = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    toxic = {r["doc_id"] for r in toxicity.scores(docs, machine).collect() if r["predicted"]}
    assert sorted(r["doc_id"] for r in civil) == sorted(r["doc_id"] for r in whole if r["doc_id"] not in toxic)

    best = {}
    for r in civil:
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in distinct) == sorted(best.values())

    ids = [r["doc_id"] for r in distinct]
    roots = plain_components([plain_print(r["text"]) for r in distinct], ids)
    assert sorted(r["doc_id"] for r in apart) == sorted(i for i, root in zip(ids, roots) if i == root)

    assert sorted(r["doc_id"] for r in mixed) == plain_mix(apart)
    assert check_pieces(pieces, [(r["doc_id"], r["text"]) for r in mixed]) > 0.9
    once = sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert [r[0] for r in once if r[1] == 0] == plain_mix(apart)
