"""The filters' wrong answers, counted over all pairs of probe keys and filters."""

from tidemark.functions import bloom


def test_all_matches_says_what_may_match_says():
    keys = [f"key{i}".encode() for i in range(500)]
    filters = [bloom.build([f"key{i * 7 + j}".encode() for j in range(n)]) for i, n in enumerate([1, 6, 9, 13, 40])] + [b"", bytes([6])]
    got = sorted(tuple(m) for m in bloom.all_matches(bloom.hashes(keys), filters))
    assert got == sorted(tuple(bloom.may_match(keys, [f] * len(keys))) for f in filters)


def test_every_probe_key_is_asked_of_every_filter(spark, monkeypatch):
    monkeypatch.setattr(bloom, "KEY_BLOCK", 16)
    monkeypatch.setattr(bloom, "FILTER_BLOCK", 16)
    blocks = {(f, i): [f"k{f}-{i}-{j}" for j in range(6)] for f in range(12) for i in range(4)}
    filters = {at: bloom.build([k.encode() for k in ks]) for at, ks in blocks.items()}
    probed = [f"new{j}" for j in range(60)] + [ks[0] for ks in list(blocks.values())[:20]]
    keys = spark.createDataFrame([(f, i * 2048, k) for (f, i), ks in blocks.items() for k in ks], "file_number long, block_offset long, user_key string")
    stored = spark.createDataFrame([(f, i, bytearray(x)) for (f, i), x in filters.items()], "file_number long, filter_index long, filter binary")
    probes = spark.createDataFrame([*enumerate(probed), (999, None)], "probe_id long, user_key string")
    yes = {(k, at): bool(bloom.may_match([k.encode()], [x])[0]) for k in probed for at, x in filters.items()}
    outside = [p for p in yes if p[0] not in blocks[p[1]]]
    got = {r.answered_by: r for r in bloom.filter_errors(keys, stored, probes).collect()}
    assert (got["filters, probes"].asked, got["filters, probes"].wrong_yes, got["filters, probes"].wrong_no) == (len(outside), sum(yes[p] for p in outside), 0)
    some = [k for k in probed[:60] if any(yes[k, at] for at in filters)]
    assert (got["filters, any"].asked, got["filters, any"].wrong_yes, got["filters, any"].wrong_no) == (80, len(some), 0)
