from lonetext.llm import jaccard_join
from lonetext.llm.jaccard_join import several_components


def test_lists_whose_sets_are_all_linked_are_not_walked_again(spark):
    members = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (2, 13), (3, 14), (3, 15), (4, 12), (4, 16)],
                                    "gram long, node long")
    labels = spark.createDataFrame([(10, 10), (11, 10), (12, 10), (14, 14), (15, 14)], "node long, component long")
    # Sets without a label are components of their own.
    assert {r.gram for r in several_components(members, labels).collect()} == {2, 4}


def test_only_open_lists_are_carried_on(spark, monkeypatch):
    """Copies with one other word each link in the first rounds; none of their lists is carried to the next."""
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[:i + 20] + [f"x{i}"] + words[i + 21:])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    written = []

    def keep(df, name, *args, **kwargs):
        table = write_out(df, name, *args, **kwargs)
        if name == "join-grams":
            written.append(table.count())
        return table

    write_out = jaccard_join.write_out
    monkeypatch.setattr(jaccard_join, "write_out", keep)
    found = jaccard_join.join_components(docs, width=1, share=85).collect()
    assert {r.component_id for r in found} == {0}
    assert sum(written) == 0
