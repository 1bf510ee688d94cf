from loomgraph.llm import quality

PROSE = [
    "The small clock was made in the town around 1583, when the workshop still used silver from the nearby hills. It was lent to the museum, but nobody knows why it came back so late.",
    "On ne sait pas pourquoi le donateur a enlevé le cadre, mais les traces des clous sont encore visibles. La surface est usée et il reste quelques traces.",
    "niemand weiß, warum der kurator den rahmen entfernt hat, aber die spuren der nägel sind noch zu sehen und es ist nicht bekannt, was das bild zeigt",
    "Prima che il mercante lo ritrovasse, nessuno sapeva che il busto esistesse ancora. È uno dei pochi pezzi che sono rimasti nello stesso edificio.",
]
OTHER = [
    "inv_no\tobject\tplace\n" + "".join(f"H-{i}\tclock\tOrlarstad\n" for i in range(30)),
    "- medal, clock, Isabella\n- panel, relief\n- oak, silver\n" * 5,
    "Home\nNext >\nCollections\nTickets\nCookies\nImprint\n" * 6,
    "The reliquary of the sacristan\nThe fresco of the town\nchalice of the donor\nThe medal of the collector\n" * 5,
    "image not available\n" * 50, "no text. " * 80, "a " * 300, "|}=|f_!!r\n 1l:, |i]it!-\\*{ 1!.\\\n" * 10, "07df2329bbc27e78b9d49c98054b1103915144" * 20,
    "It is a list that was kept by the donor.\n" + "".join(f"{i}. Medal, wool, 17{i}.\n" for i in range(10, 60)),
]


def corpus(spark, extra=()):
    rows = [(i, t) for i, t in enumerate(PROSE * 20)] + [(1000 + i, t) for i, t in enumerate(OTHER * 4)] + list(extra)
    return spark.createDataFrame([(i, t, 0.0) for i, t in rows], "doc_id bigint, text string, p_prose double")


def test_types_are_told_apart(spark):
    found = {r["doc_id"]: r for r in quality.text_types(corpus(spark, [(5000, None), (5001, ""), (5002, " \n "), (5003, " ")])).collect()}
    assert len(found) == 20 * len(PROSE) + 4 * len(OTHER)
    wrong = [i for i, r in found.items() if (r["p_prose"] < 0.5) != (i >= 1000)]
    assert not wrong
    assert all(abs(r["p_prose"] + r["p_list"] + r["p_junk"] - 1) < 1e-9 for r in found.values())


def test_statistics_by_hand():
    s = dict(zip(quality.NAMES, quality.statistics("The cat is here.\r\n\r\nab 12 %%")))
    assert s["n_words"] == 5 and s["mean_word_length"] == (3 + 3 + 2 + 5 + 2 + 2 + 2) / 7
    assert s["symbol_ratio"] == 3 / 19 and s["digit_ratio"] == 2 / 19 and s["end_ratio"] == 0.5 and s["common_ratio"] == 2 / 5


def test_long_repeated_and_empty(spark):
    long = [(7000, PROSE[0] * 3000), (7000, PROSE[0] * 3000), (None, PROSE[1])]
    rows = quality.text_types(corpus(spark, long)).where("doc_id = 7000 OR doc_id IS NULL").collect()
    assert len(rows) == 3 and all(r["p_prose"] > 0.5 for r in rows)
    assert quality.text_types(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
