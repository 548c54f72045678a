import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, fp string, score double, kept string, copy_no int, __name string, __source string, __text string, __clean string, __digest_own long, own int, name string, steps double, f int"


def _rows():
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    passage = " ".join(f"shared{i}" for i in range(60))
    texts = {
        1: "The quick brown fox jumps over the lazy dog near the old river bank today.",
        2: None,
        3: "",
        4: " \t\n \x0b ",
        5: "The quick brown fox jumps over the lazy dog near the old river bank today.",
        6: long_text,
        7: f"start {passage} end. mail jo.doe+x@mail.example.com or +1 (389) 555-5010",
        8: f"other {passage} close.\nÀ 4337166598464399 é 10.0.0.255 and 999.1.1.1 😀",
        9: "one",
        10: "a a a a a a a a a a\na a a a a a a a a a\nb\nb\n\nB",
        11: "### *** $$$ %%% SHOUTING LOUD WORDS ONLY!! HERE!!\n" * 40,
        12: "Ünïcode wörds ünd mehr hard spaces.  Two  spaces \n end ",
    }
    rows = [(i, t, "en", "s" if i % 3 else None, len(t) if t is not None else None) for i, t in texts.items()]
    rows.append((None, "A row that has no id but a text of its own. It stands alone here.", None, "s", 0))
    rows.append(rows[0])
    rows.append((1, "Another text under an id that is taken.", "en", "t", 3))
    return [(*r, 7, "x", 0.5, "no", 3, "n", "s", "t", "c", 11, 12, "m", 1.5, 9) for r in rows]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names operators use themselves."""
    return spark.createDataFrame(_rows(), COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
