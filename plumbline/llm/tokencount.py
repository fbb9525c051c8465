"""Token counts of a SentencePiece BPE model, with a whole-token shortcut.

Offline, on the driver, the vocabulary is searched for facts that hold for every text:
* where no piece can reach across, so a text may be cut: before each space mark that follows another character,
  and around control characters that occur in no longer piece (and are pieces, or fall back to bytes);
* which pieces, taken alone, come out of the encoder as one token.
On the workers a text is cut there to pre-tokens. One that is in the proven table counts as one token without
merging; the rest are merged by the library, once per distinct pre-token, and remembered in a table of bounded
size. A model for which the facts don't hold (a rewriting normaliser, user-defined pieces, pieces that cross
space marks) is served by encoding whole texts.

Null text counts as empty (0 bytes, 0 tokens). Whole texts are counted, however long; long pre-tokens are not
remembered. Repeated rows stay (ties have no part in a count); empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: characters at which a text may be cut on both sides, where the vocabulary allows it
CUTS = "\n\t"
MEMO, MEMO_LENGTH = 1_000_000, 64
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


def model_facts(model: bytes) -> dict:
    """What the vocabulary proves: {whole: pieces that encode alone to one token, cuts: characters} or {} where texts can't be cut."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    norm = proto.normalizer_spec
    pieces = [p.piece for p in proto.pieces if p.type == p.NORMAL]
    plain = norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    crossing = any(MARK in p.lstrip(MARK) for p in pieces)
    if not plain or crossing or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type == p.USER_DEFINED for p in proto.pieces):
        return {}
    cuts = "".join(c for c in CUTS if not any(c in p for p in pieces if len(p) > 1))
    # An unknown character would be merged with unknown neighbours, and a cut would part them.
    if "\n" not in cuts or not (proto.trainer_spec.byte_fallback or {MARK, *cuts} <= set(pieces)):
        return {}
    encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
    counts = segment_counts(encoder, pieces)
    return {"whole": {p: 1 for p, n in zip(pieces, counts) if n == 1}, "cuts": cuts}


def segment_counts(encoder, segments: list[str]) -> list[int]:
    """Tokens of each segment as it stands inside a text. The encoder puts a space mark before what it gets:
    a segment's own first mark is taken off, and others follow a line feed, where texts can be cut."""
    lead = len(encoder.encode("\n"))
    given = [s[1:] if s[0] == MARK else "\n" + s for s in segments]
    out = encoder.encode(given, num_threads=1)
    return [1 if s == MARK else len(x) - (0 if s[0] == MARK else lead) for s, x in zip(segments, out)]


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of docs."""
    with open(model_path, "rb") as f:
        model = f.read()
    # The model file and the proven table are as large as the vocabulary: a bounded broadcast.
    shared = docs.sparkSession.sparkContext.broadcast((model, model_facts(model)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model, facts = shared.value
        encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        if facts:
            cuts = re.escape(facts["cuts"])
            segments = re.compile(f"{MARK}+[^{MARK}{cuts}]*|[^{MARK}{cuts}]+|[{cuts}]").findall
            known = dict(facts["whole"])
        for batch in batches:
            texts = batch.column(1).to_pylist()
            if not facts:
                counts = [len(encoder.encode(t, num_threads=1)) if t else 0 for t in texts]
            else:
                counts = []
                for t in texts:
                    found = segments(MARK + t.replace(" ", MARK)) if t else []
                    missing = list({s for s in found if s not in known})
                    if missing:
                        new = dict(zip(missing, segment_counts(encoder, missing)))
                        if len(known) + len(new) > MEMO + len(facts["whole"]):
                            known = dict(facts["whole"])
                            new = dict(zip(m := list(set(found) - known.keys()), segment_counts(encoder, m))) if found else {}
                        known.update(new)
                        counts.append(sum(map(known.__getitem__, found)))
                        for s in missing:
                            if len(s) > MEMO_LENGTH:
                                known.pop(s, None)
                    else:
                        counts.append(sum(map(known.__getitem__, found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, SCHEMA)
