"""Every accepted reading is found, whatever its share of the corpus and however many there are."""

import random

from paragrove.llm import scannoise

LETTERS = "abcdefghilmnoprstuvy"


def misread(word, rng, confusions, others=0):
    """The word as a scanner might read it."""
    swaps = [(a, b) for a, b in scannoise.CONFUSIONS if a.isalpha() and b.isalpha() and b in word]
    for a, b in rng.sample(swaps, min(confusions, len(swaps))):
        word = word.replace(b, a, 1)
    for _ in range(others):
        i = rng.randrange(len(word))
        word = word[:i] + rng.choice(LETTERS) + word[i + 1:]
    return word


def test_trie_and_keys_miss_no_accepted_reading():
    rng = random.Random(11)
    found = 0
    for size in [3, 4, 5, 6, 8, 11, 16] * 12 + [28, 31, 35, 36, 39, 40, 44, 200]:
        printed = "".join(rng.choice(LETTERS) for _ in range(size))
        trie = scannoise.Trie({printed: 20_000})
        for confusions, others in ((1, 0), (2, 0), (3, 0), (4, 0), (0, 1), (1, 1)):
            seen = misread(printed, rng, confusions, others)
            cost = scannoise.channel_cost(seen, printed)
            got = [(w, n, round(c, 6)) for w, n, c in trie.meant(seen)]
            assert got == ([(printed, 20_000, round(cost, 6))] if cost <= scannoise.MOST_COST else [])
            if scannoise.accepted(seen, 1, printed, 20_000, cost):
                found += 1
                assert scannoise.seen_keys(seen, 1) & scannoise.printed_keys(printed, 20_000)
            if scannoise.accepted(seen, 1, printed, 20, cost):
                assert scannoise.seen_keys(seen, 1) & scannoise.printed_keys(printed, 20)
    assert found > 300


def fixes(spark, monkeypatch, counts, seen, rare):
    from paragrove.runtime import Shelf

    monkeypatch.setattr(scannoise, "RARE", rare)
    rows = [(" ".join([w] * 10),) for w, n in counts.items() for _ in range(n // 10)] + [(w,) for w in seen]
    shelf = Shelf(spark)
    lexicon = scannoise.Lexicon(spark.createDataFrame(rows, "text string"), shelf)
    odd = spark.createDataFrame([(w,) for w in seen], "word string")
    return lexicon, {r.word: [o.reading for o in r.options] for r in scannoise.corrections(odd, lexicon, shelf).collect()}


def test_share_of_a_word_does_not_decide_whether_it_is_a_reading(spark, monkeypatch):
    """Seven readings, three confusions, another letter, 4 edits beside a nearer word, and 50 letters: the same by the trie and by joins."""
    long = "delineatormarkerplacardbarricadechannelizerobjects"
    seven = {"pcats", "pcots", "peots", "poats", "pects", "pacts", "poets"}
    counts = {w: 400 for w in (*seven, "marker", "symbol", "modern", "modem", long)} | {"the": 900}
    want = {"pcets": seven, "mankcn": {"marker"}, "sympol": {"symbol"}, "rnodern": {"modern", "modem"}, long.replace("l", "i", 1).replace("j", "i"): {long}}
    shares = [fixes(spark, monkeypatch, counts, list(want), rare) for rare in (1e-5, 0.1)]
    assert "symbol" in shares[0][0].vocabulary and "symbol" not in shares[1][0].vocabulary
    assert shares[0][1] == shares[1][1]
    assert {w: set(r) for w, r in shares[0][1].items()} == want
