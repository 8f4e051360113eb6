import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session




def thue_morse(size, letters="ab"):
    """A word that hashes by polynomials modulo a power of two confuse with its complement."""
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


SF = "/root/testdata/sf0.001"
#: Nulls, empty texts, blanks, ties, repeated rows, long words and texts, other alphabets.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three"), (5, "one two three"), (6, "one two three"), (None, "no id here at all"), (None, None),
    (7, "x" * 70_000), (8, "from " * 3000), (9, "Straße déjà vu  日本語 <|endoftext|> it's a ΣΑΣ"), (10, "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 200),
    (11, "\n".join(["same line here"] * 6)), (12, "a b\r\nc d\r\n\r\n12,345 !!! ### $$$"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, None if i == 4 else "en", None if i == 2 else "s", 1, 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, copy int, kept int")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
