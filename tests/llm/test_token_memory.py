"""What a worker remembers of encoded pieces, and for how long."""

from pyspark import cloudpickle
from tokenizers import Tokenizer

from evalloom.llm import tokens
from evalloom.llm.queries import tokenizer_path
from evalloom.llm.words import tidy


def ids(raw):
    return [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)]


def test_a_worker_keeps_its_memory_between_tasks():
    path = tokenizer_path()

    def work(batches):
        kept = path in tokens._encoders
        tokens.Encoder.of(path)
        yield kept

    def other(batches):
        yield path in tokens._encoders

    # As Spark sends them: once a task.
    sent, next_one = cloudpickle.dumps(tidy(work)), cloudpickle.dumps(tidy(other))
    tasks = [list(cloudpickle.loads(x)(iter([]))) for x in (sent, sent, sent, next_one, sent)]
    assert tasks == [[False], [True], [True], [False], [False]]


def test_a_full_memory_keeps_what_is_met_again(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 40)
    encoder, library = tokens.Encoder(tokenizer_path()), Tokenizer.from_file(tokenizer_path())
    made = []
    make = encoder._piece
    encoder._piece = encoder.seen.make = lambda piece: made.append(piece) or make(piece)
    for i in range(60):
        text = f"again again, and Größe, {'x' * i}{chr(97 + i % 26)} word{chr(97 + i % 7)}!? 世界{i}.\n{i}th line's end;"
        (raw,) = encoder.encode([text])
        assert ids(raw) == library.encode(text, add_special_tokens=False).ids
        assert len(encoder.seen) + len(encoder.seen.before) <= 40 + 2 * 20
    assert made.count("again,") == made.count("Größe,") == 1
