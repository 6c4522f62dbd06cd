import pyarrow as pa

from donorframe.llm.quality import find_lexicon, vote
from donorframe.llm.textcore import buffers


def test_copies_of_a_long_text_leave_room_for_other_words(spark):
    long = " ".join(f"w{i:05d}x{i * 7919 % 99991:05d}" for i in range(6000))
    texts = [long] * 30 + [f"zqvile {chr(97 + i)}{chr(98 + i)}" for i in range(8)] + [f"plain words of the day {i}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i < 38)) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    votes = vote(*buffers(pa.array(["zqvile once more", "w00001x07919", "plain words"])), find_lexicon(docs, labels))
    assert votes[6].tolist() == [2, 0, 0]
