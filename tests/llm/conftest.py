import pytest

from custos.session import ensure_checkpoint_dir, get_spark


@pytest.fixture(scope="session")
def spark():
    s = get_spark("local[*]", 8, app_name="custos-tests")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def documents(spark):
    """Every hard case in one small table, with columns whose names the operators use themselves."""
    long = " ".join(f"long{i}" for i in range(6000))
    base = [f"word{i}" for i in range(60)]
    near = base[:30] + ["changed"] + base[31:]
    passage = " ".join(f"shared{i}" for i in range(50))
    rows = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, f"one two {passage} three"), (5, f"{passage} end"),
        (6, None), (7, ""), (8, " \n\t "), (9, "single"), (10, "single"), (11, long), (12, "der " * 80), (13, "| | ! !"),
        (None, "no id here"), (None, None), (14, " ".join(base).upper()), (15, "repeated row"), (15, "repeated row"),
        (16, "Was ist das, été ñandú"), (16, "another text of the same id"),
    ]
    kind = ("doc_id bigint, text string, lang string, source string, n_chars bigint, n_words int, n_tokens string, mark string, "
            "component_id string, score double, copies int, figures string, leader string, hit_id int, row string, `odd name.``x` int")
    return spark.createDataFrame(
        [(i, t, ["en", "de", None][k % 3], [None, "src1", "src2", "src0"][k % 4], len(t or ""), k, "x", "m", "c", 0.5, 7, "f", "l", 1, "r", 3)
         for k, (i, t) in enumerate(rows)], kind)


@pytest.fixture(scope="session")
def nothing(spark, documents):
    return spark.createDataFrame([], documents.schema)
