import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_ids_are_the_librarys(spark, library):
    rng = random.Random(2)
    alphabet = "ab \n'sét12.,-_İΣßÀ\x1c\x85\xa0…’日😀"
    texts = ["", "it's 'tis I'LL", "<|endoftext|> x", "a" * 3000] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(800)]
    words = packing.word_ids(PATH)
    for t in texts + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]:
        assert np.frombuffer(words.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    plain = ["".join(rng.choices("aB \n\t\r\x0b\x0c'séT12.,-_ßÀÝŽǅ–“…", k=rng.randint(0, 40))) for _ in range(800)]
    for t, ids in zip(texts + plain, words.encode_all(texts + plain), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_knapsack_is_optimal():
    rng = random.Random(3)
    for _ in range(30):
        lengths = sorted(rng.sample(range(1, 70), 6))
        values = [rng.random() * x for x in lengths]
        chosen = packing.price(np.array(lengths), np.array(values), 130)
        assert sum(lengths[k] * n for k, n in chosen.items()) <= 130
        best = [0.0] * 131
        for c in range(1, 131):
            best[c] = max([best[c - 1]] + [best[c - x] + v for x, v in zip(lengths, values) if x <= c])
        assert sum(values[k] * n for k, n in chosen.items()) == pytest.approx(best[130])


@pytest.mark.parametrize("case", [{}, {4096: 3}, {1: 5000}, {4095: 2, 1: 1}, {2049: 9, 2047: 9, 2048: 3}, {1366: 30, 1365: 60}])
def test_small_histograms(case):
    packed = packing.pack(case)
    held = Counter()
    for lengths, n in packed:
        assert sum(lengths) <= 4096 and n > 0
        for x in lengths:
            held[x] += n
    assert held == Counter(case)
    assert sum(n for _, n in packed) >= math.ceil(sum(x * n for x, n in case.items()) / 4096)


def test_large_histogram_is_near_the_bound():
    rng = random.Random(4)
    case = Counter(min(4095, int(rng.lognormvariate(6.4, 1)) + 1) for _ in range(3000))
    case = {x: n * 40 for x, n in case.items()}
    assert sum(n for _, n in packing.pack(case)) <= 1.005 * sum(x * n for x, n in case.items()) / 4096


def lengths_of(documents, times):
    rng = random.Random(5)
    case = Counter(min(4095, int(rng.lognormvariate(6.4, 1)) + 1) for _ in range(documents))
    return {x: n * times for x, n in case.items()}


@pytest.mark.parametrize(("documents", "times"), [(600, 1), (600, 40), (20000, 300)])
def test_program_and_packing_are_near_the_bound(documents, times):
    case = lengths_of(documents, times)
    program = packing.solve(case)
    assert all(sum(x * n for x, n in chosen.items()) <= 4096 and amount > 0 for chosen, amount in program.amounts)
    tokens = sum(x * n for x, n in case.items())
    used, alone = (sum(n for _, n in p) for p in (packing.pack(case), packing.best_fit(dict(case), [], 4096)))
    assert tokens / 4096 - 1e-6 <= program.bound <= program.sequences + 1e-6 and used <= alone
    assert used <= max(1.001 * program.bound, program.bound + 2)


def test_program_finds_what_best_fit_misses():
    """Best fit takes 2550 sequences; the optimum, found by hand, is 2300."""
    case = {1366: 3000, 1365: 3000, 1364: 500, 2049: 100}
    program = packing.solve(case)
    assert 2300 * 0.995 <= program.bound <= 2300 <= program.sequences * 1.0005
    packed, by = packing.packed_by(case)
    assert by == "program" and sum(n for _, n in packed) <= 2303
    assert sum(n for _, n in packing.best_fit(dict(case), [], 4096)) == 2550


def test_amounts_cover_the_histogram():
    """What the program's amounts leave open is what it says: a sequence for as many pieces as one takes."""
    rng = random.Random(11)
    for _ in range(6):
        case = {rng.randint(200, 2100): rng.randint(1, 400) for _ in range(12)}
        program = packing.solve(case)
        served = Counter()
        for chosen, amount in program.amounts:
            for x, n in chosen.items():
                served[x] += n * amount
        rest = sum(max(0.0, n - served[x]) / (4096 // x) for x, n in case.items())
        assert sum(a for _, a in program.amounts) + rest == pytest.approx(program.sequences, rel=1e-3)
        assert program.bound <= program.sequences + 1e-6 and program.sequences <= 1.03 * program.bound


def test_program_of_lengths_that_fill_no_sequence():
    program = packing.solve({3000: 50, 2900: 7})
    assert 56 < program.bound <= 57 and program.sequences <= 57 + 1e-6
    assert sum(n for _, n in packing.pack({3000: 50, 2900: 7})) == 57
    assert packing.solve({}).amounts == [] and packing.pack({5: 0}) == []


def test_dual_bound_is_one():
    """Against the least number of sequences by search, on small capacities."""
    rng = random.Random(8)

    def fewest(pieces, room):
        if not pieces:
            return 0
        best = len(pieces)
        for mask in range(1, 2 ** (len(pieces) - 1) * 2, 2):  # sequences that hold the first piece
            chosen = [p for k, p in enumerate(pieces) if mask >> k & 1]
            if sum(chosen) <= room:
                best = min(best, 1 + fewest([p for k, p in enumerate(pieces) if not mask >> k & 1], room))
        return best

    for _ in range(8):
        pieces = [rng.randint(1, 20) for _ in range(7)]
        assert packing.solve(Counter(pieces), 20).bound <= fewest(sorted(pieces), 20) + 1e-9
        assert sum(n for _, n in packing.pack(Counter(pieces), 20)) >= fewest(sorted(pieces), 20)


def check(rows, texts, library):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        parts = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // 4096)))
        for p in parts:
            own = ids[p.start : p.start + 4096]
            assert (p.start, p.length, p.ids_crc32) == (p.piece * 4096, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096


def test_query(spark, library):
    from lodestone.llm.queries import op5_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op5_packing(spark, SF).collect()
    check(rows, texts, library)
    assert len({r.sequence_id for r in rows}) <= 1.02 * math.ceil(sum(r.length for r in rows) / 4096) + 1


def test_edges_and_salted_ranks(spark, library, monkeypatch):
    monkeypatch.setattr(packing, "SALT_ROWS", 7)
    texts = {1: None, 2: "", 3: "same text", 4: "same text", 5: "long " * 9000} | {i: "hot copy" for i in range(10, 90)}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, length int")
    check(packing.pack_documents(df, PATH).collect(), texts, library)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0
