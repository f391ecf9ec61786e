"""Hidden Markov language model: Baum-Welch over blocks of texts, scaled forward scores."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import discard, packed, save, table, unpacked

STATES = 6
#: Passes of Baum-Welch over all training documents.
PASSES = 2
#: Words that occur up to so often share their states' counts with those that occur as
#: often, each word getting an equal part.
RARE = 5
#: In the first pass each block makes so many rounds over all its training documents, from
#: emissions that differ by a hash of the word and so are the same in all blocks.
START_ROUNDS = 4
#: Counting cuts documents into sequences of at most so many tokens; scoring does not.
CUT_TOKENS = 512
#: Share of the corpus's own distribution in each state's.
SHARED = 0.05
#: A block takes texts until they have so many bytes; its recursions take so many tokens.
BLOCK_BYTES, BATCH_TOKENS = 12 << 20, 250_000
#: Words are dealt to shares by their hash; a share takes about so many words of blocks,
#: and there are at least so many shares.
SHARE_WORDS, LEAST_SHARES = 400_000, 64
#: No word holds a space.
END = b" "


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


class Numbers(dict):
    """Tokens -> codes of a block, the end first."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self)
        return code

    def codes(self, text: bytes):
        """Codes of a text's words and its end. Bytes part and lower-case at ASCII alone."""
        import numpy as np

        words = text.lower().split()
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def batches_of(length):
    """Indexes of sequences, longest first, in batches of about ``BATCH_TOKENS``."""
    import numpy as np

    order = np.argsort(-length, kind="stable")
    if not order.size:
        return []
    at = (np.cumsum(length[order]) - 1) // BATCH_TOKENS
    return np.split(order, np.flatnonzero(np.diff(at)) + 1)


def side_by_side(codes, start, length):
    """Tokens of sequences, longest first, by step: all first tokens, all second ones, ...;
    and where each step begins."""
    import numpy as np

    running = np.searchsorted(-length, -np.arange(length[0]), side="left")
    offset = np.concatenate([[0], np.cumsum(running)])
    step = np.repeat(np.arange(length[0]), running)
    sequence = np.arange(offset[-1]) - offset[step]
    return codes[start[sequence] + step], offset


def expected(codes, start, length, opens, emit, moves, first, within):
    """Baum-Welch counts of the sequences at ``start`` of ``length``, which begin a text
    (``opens``) or go on with one: (codes x states, states x states, states). ``emit``
    has a row per code; ``first`` and ``within`` are what the two kinds begin with."""
    import numpy as np

    # Tables inside have a row per state, so that numpy's loops run along the tokens.
    states, by_state, back = len(moves), np.ascontiguousarray(emit.T), np.ascontiguousarray(moves.T)
    counts, moved, begun = np.zeros((states, len(emit))), np.zeros_like(moves), np.zeros(states)
    for some in batches_of(length):
        token, offset = side_by_side(codes, start[some], length[some])
        offset, e = offset.tolist(), by_state.take(token, axis=1)
        alpha, scale = np.empty_like(e), np.empty(len(token))
        a = np.where(opens[some], first[:, None], within[:, None])
        for t in range(len(offset) - 1):
            lo, hi = offset[t], offset[t + 1]
            a = np.multiply(back @ a[:, : hi - lo] if t else a, e[:, lo:hi], out=alpha[:, lo:hi])
            a /= a.sum(0, out=scale[lo:hi])
        e /= scale
        beta = np.ones((states, offset[-1] - offset[-2]))
        for t in range(len(offset) - 2, 0, -1):
            lo, hi, before = offset[t], offset[t + 1], offset[t - 1]
            ahead = np.multiply(e[:, lo:hi], beta, out=e[:, lo:hi])
            moved += alpha[:, before : before + hi - lo] @ ahead.T
            alpha[:, lo:hi] *= beta
            beta = np.ones((states, lo - before))
            beta[:, : hi - lo] = moves @ ahead
        alpha[:, : offset[1]] *= beta
        begun += alpha[:, : offset[1]][:, opens[some]].sum(1)
        for k in range(states):
            counts[k] += np.bincount(token, weights=alpha[k], minlength=len(emit))
    return counts.T, moved * moves, begun


def log_likelihoods(codes, start, length, emit, moves, first):
    """log10 probability of each sequence, by the scaled forward recursion."""
    import numpy as np

    order = np.argsort(-length, kind="stable")
    at, total = np.asarray(start)[order], np.zeros(len(start))
    by_state, back = np.ascontiguousarray(emit.T), np.ascontiguousarray(moves.T)
    # A step takes one token of each sequence that has so many.
    running = np.searchsorted(-length[order], -np.arange(length.max(initial=0)), side="left")
    for t, n in enumerate(running):
        a = (back @ a[:, :n] if t else first[:, None]) * by_state.take(codes[at[:n] + t], axis=1)
        s = a.sum(0)
        a /= s
        total[:n] += np.log10(s)
    out = np.empty(len(start))
    out[order] = total
    return out


def cut(length):
    """(start, length, opens) of sequences of at most ``CUT_TOKENS`` of texts that follow
    each other."""
    import numpy as np

    pieces = -(-length // CUT_TOKENS)
    text = np.repeat(np.arange(len(length)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = (np.cumsum(length) - length)[text] + nth * CUT_TOKENS
    return start, np.minimum(CUT_TOKENS, length[text] - nth * CUT_TOKENS), nth == 0


class Model:
    """What all words share: counts of the states' moves and beginnings, of the words that
    occur 1 to ``RARE`` times (``rare``, by count) and of the others together (``used``).
    ``sizes`` are the numbers of words that occur 1 to ``RARE`` times."""

    def __init__(self, used, rare, sizes, moved, begun, n_train: int):
        import numpy as np

        rare, self.sizes, self.n_train = np.asarray(rare, float), np.asarray(sizes, float), n_train
        self.used = np.asarray(used, float) + rare.sum(0)
        moved, begun = np.asarray(moved, float) + 0.1, np.asarray(begun, float) + 0.1
        self.moves, self.first = moved / moved.sum(1, keepdims=True), begun / begun.sum()
        self.within = (self.used + 0.1) / (self.used + 0.1).sum()
        # Turing's estimate of what a state says that training has not seen.
        self.unseen = (rare[0] + 0.1) / (self.used + 0.2) if n_train else np.ones(len(self.used))
        self.rare = rare / np.maximum(self.sizes, 1)[:, None]

    def emissions(self, c, code, own):
        """Rows of probabilities by code, whose training counts are ``c``: a frequent
        word's from its ``own`` counts by state, at ``code``, all mixed with the corpus's.
        What training has not seen shares one outcome."""
        import numpy as np

        by_state = np.zeros((len(c), len(self.used)))
        by_state[code] = own
        rare = (c > 0) & (c <= RARE)
        by_state[rare] = self.rare[c[rare] - 1]
        by_state /= np.where(self.used > 0, self.used, 1.0)
        shared = np.where(self.used > 0, SHARED, 1.0)
        emit = (1 - self.unseen) * ((1 - shared) * by_state + shared * (c / max(1, self.n_train))[:, None])
        emit[c == 0] = self.unseen
        return emit


def start_weights(seeds, states: int):
    """A row per word of uneven shares of the states, from the hash of the word."""
    import numpy as np

    k = np.arange(2 * states, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = np.asarray(seeds).astype(np.int64).view(np.uint64)[:, None] + k
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    drawn = -np.log(((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / 2.0**53 + 1e-12)
    drawn = drawn[:, :states] + drawn[:, states:]
    return drawn / drawn.sum(1, keepdims=True)


def by_count(own, c):
    """Sums of the rows of words that occur 1 to ``RARE`` times."""
    import numpy as np

    return np.stack([own[c == n].sum(0) for n in range(1, RARE + 1)])


def pressed(numbers, kind) -> bytes:
    """Bytes of numbers, packed plane by plane: all first bytes, all second ones, ...,
    as the higher bytes of codes and of counts are much alike."""
    import numpy as np

    numbers = np.ascontiguousarray(numbers, kind).ravel()
    return packed(np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize).T), np.uint8)


def unpressed(data, size: int, kind):
    import numpy as np

    kind = np.dtype(kind)
    return np.ascontiguousarray(unpacked(data, size * kind.itemsize, np.uint8).reshape(kind.itemsize, size).T).view(kind).ravel()


def hashes(words):
    """Numbers of 32 bits by word, which deal words to shares and start them."""
    import numpy as np

    return np.fromiter(map(zlib.crc32, words), np.int64, len(words))


def cells_of(table, name: str, kind, sizes):
    """Arrays of the binary cells of a column, of so many numbers each."""
    return [unpressed(x.as_buffer(), n, kind) for x, n in zip(table.column(name), sizes, strict=True)]


def stored(df: DataFrame, name: str) -> DataFrame:
    """As ``save``, but files shuffled for it go when it is written, and not when the
    driver's memory is next swept."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return save(df, name)
    finally:
        conf.set(key, before)


def blocks_of(docs: DataFrame) -> DataFrame:
    """Stored blocks of ``docs(doc_id, text)``: the ``size`` codes of their tokens, packed,
    lengths, ids and which are held out, and the block's ``n_words`` words with training
    counts (``here``), packed, in order of their codes, which is that of their hashes."""
    import numpy as np

    fields = "block long, size long, codes binary, length array<int>, doc_id array<long>, held_out array<boolean>, n_words long, n_bytes long, words binary, here binary"

    def made(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId(), 0

        def flush():
            words, length = list(number), np.array([len(f) for f in found], np.int32)
            order = np.argsort(hashes(words), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            codes = rank[np.concatenate(found)]
            here = np.bincount(codes[~np.repeat(held, length)], minlength=len(number))
            # No word holds a line feed, and the end is none.
            joined = b"\n".join([words[i] for i in order])
            cells = [(task << 32) + seq, len(codes), pressed(codes, np.int32), length, ids, held, len(words), len(joined), packed(np.frombuffer(joined, np.uint8), np.uint8), pressed(here, np.int64)]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(cells, types, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

        number, found, ids, held, size = Numbers(), [], [], [], 0
        for batch in batches:
            for doc_id, out, cell in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = cell.as_py()
                found.append(number.codes(text))
                ids.append(doc_id)
                held.append(out)
                size += len(text)
                if size >= BLOCK_BYTES:
                    yield flush()
                    number, found, ids, held, size = Numbers(), [], [], [], 0
                    seq += 1
        if found:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).cast("string").cast("binary").alias("text"))
    return stored(texts.mapInArrow(made, fields), "blocks")


#: What goes between a block and a share: of the ``n`` words of the block that are in the
#: share their training counts, packed, and for the frequent ones their ids in the share
#: and a hash or, later, counts by state but the last, as all of them make the word's
#: count. ``sums`` are added up over all rows.
DEALT = "block long, share int, n long, c binary, often long, id binary, {own} binary, sums array<double>"


def dealt(rows: list[tuple], own: str):
    import pyarrow as pa

    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.float64())]
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.table([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in DEALT.format(own=own).split(", ")])


def numbered_words(raw: DataFrame, states: int) -> DataFrame:
    """Stored rows of ``DEALT`` with hashes: the words of all blocks, counted over them
    and numbered by share. The sums are how many words occur 1 to ``RARE`` times and
    more often, how many tokens they make, and the frequent words' first counts by state."""
    import numpy as np

    shares = max(LEAST_SHARES, -(-(raw.agg(F.sum("n_words")).first()[0] or 0) // SHARE_WORDS))

    def split(batches):
        import pyarrow as pa

        for batch in batches:
            for row in range(batch.num_rows):
                block, n, size, words, here = (batch.column(k)[row].as_py() for k in range(5))
                words, here = pa.decompress(words, decompressed_size=size, codec="zstd", asbytes=True).split(b"\n"), unpressed(here, n, np.int64)
                ends = np.searchsorted((hashes(words) * shares) >> 32, np.arange(shares + 1)).tolist()
                some = [(k, lo, hi) for k, (lo, hi) in enumerate(zip(ends, ends[1:])) if lo < hi]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _, _ in some], pa.int32()), pa.array([block] * len(some), pa.int64()), pa.array([b"\n".join(words[lo:hi]) for _, lo, hi in some], pa.binary()), pa.array([pressed(here[lo:hi], np.int64) for _, lo, hi in some], pa.binary())],
                    names=["share", "block", "words", "here"],
                )

    def numbered(table):
        share, number = table.column("share")[0].as_py(), {}
        ids = []
        for cell in table.column("words"):
            words = cell.as_py().split(b"\n")
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        total, seed = np.zeros(len(number), np.int64), hashes(number)
        for i, here in zip(ids, cells_of(table, "here", np.int64, map(len, ids)), strict=True):
            total[i] += here
        kind = np.minimum(total, RARE + 1)
        first = (total[kind > RARE][:, None] * start_weights(seed[kind > RARE], states)).sum(0)
        sums = [np.bincount(kind, minlength=RARE + 2)[1:], np.bincount(kind, weights=total, minlength=RARE + 2)[1:], first]
        rows = [(None, share, 0, None, 0, None, None, np.concatenate(sums))]
        for block, i in zip(table.column("block").to_pylist(), ids, strict=True):
            often = i[total[i] > RARE]
            rows.append((block, share, len(i), pressed(total[i], np.int64), len(often), pressed(often, np.int32), pressed(seed[often], np.uint32), None))
        return dealt(rows, "seed")

    words = raw.select("block", "n_words", "n_bytes", "words", "here").mapInArrow(split, "share int, block long, words binary, here binary")
    return stored(words.groupBy("share").applyInArrow(numbered, DEALT.format(own="seed")), "numbered")


def added(rows: DataFrame) -> dict[int, float]:
    """The sums of all rows, by place."""
    return {r.pos: r.total for r in rows.select(F.posexplode("sums")).groupBy("pos").agg(F.sum("col").alias("total")).collect()}


def score_texts(docs: DataFrame, states: int = STATES, passes: int = PASSES, start_rounds: int = START_ROUNDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one per
    row of ``docs(doc_id, text)``.

    Texts are numbered in blocks, each with its own words. Words are counted over all
    training blocks; each pass brings the words' counts by state to the blocks that hold
    them, runs forward and backward there and sums what comes out by word. Words are
    dealt to shares by their hash, and a block and a share exchange one row, with the
    words that both have. A frequent word is thus once in each block, and no table of
    words has to fit in memory; what all words share is a few numbers. Scores are exact
    log10 probabilities of whole texts. The model, like the base, treats all words that
    training lacks as one outcome.

    A null or empty text is its end alone, a null doc_id is learned from and stays null,
    repeated rows count each, a long text is a block of its own. Without training
    documents every word has probability 1.
    """
    import numpy as np

    raw = blocks_of(docs)
    known = numbered_words(raw, states)
    found = added(known)
    found = np.array([found.get(k, 0.0) for k in range(2 * (RARE + 1) + states)])
    n_words, n_train = (int(found[k : k + RARE + 1].sum()) for k in (0, RARE + 1))
    sizes, tokens, often, used = found[:RARE], found[RARE + 1 : 2 * RARE + 1], found[2 * RARE + 1], found[2 * (RARE + 1) :]
    # At the start, states are held for some words and begin texts alike, and rare words
    # are as frequent in every state as in the corpus.
    share = used / used.sum() if used.any() else np.full(states, 1 / states)
    rare = np.outer(tokens, share) * (used.sum() / max(1, n_train - tokens.sum()) if used.any() else 1.0)
    model = Model(used, rare, sizes, np.full((states, states), 1.0) + np.eye(states) * 20 * states, np.ones(states), n_train)

    def joined(known, *columns):
        words = known.where("block is not null").drop("sums").withColumnRenamed("block", "of")
        return raw.select("block", "size", "codes", "length", "held_out", *columns).groupBy("block").cogroup(words.groupBy("of"))

    def opened(block, words, model):
        words = words.sort_by("share")
        sizes, often = (words.column(k).to_pylist() for k in ("n", "often"))
        c = np.concatenate(cells_of(words, "c", np.int64, sizes))
        code = np.flatnonzero(c > RARE)
        if "seed" in words.column_names:
            own = c[code][:, None] * start_weights(np.concatenate(cells_of(words, "seed", np.uint32, often)), states)
        else:
            own = np.concatenate(cells_of(words, "own", np.float32, [n * (states - 1) for n in often])).reshape(len(code), states - 1)
            own = np.column_stack([own, np.maximum(0.0, c[code] - own.sum(1, dtype=float))])
        codes = unpressed(block.column("codes")[0].as_buffer(), block.column("size")[0].as_py(), np.int32)
        return words, codes, block.column("length")[0].values.to_numpy(), c, code, model.emissions(c, code, own)

    def counting(model, rounds):
        def count(block, words):
            words, codes, length, c, code, emit = opened(block, words, model)
            learned = ~block.column("held_out")[0].values.to_numpy(zero_copy_only=False)
            codes, length = codes[np.repeat(learned, length)], length[learned]
            # Rounds before the last go on from the block's own counts.
            now, pieces = model, cut(length)
            for k in range(rounds):
                counts, moved, begun = expected(codes, *pieces, emit, now.moves, now.first, now.within)
                if k + 1 < rounds and len(codes):
                    now = Model(counts[code].sum(0), by_count(counts, c), np.bincount(np.minimum(c, RARE + 1), minlength=RARE + 2)[1 : RARE + 1], moved, begun, n_train)
                    emit = now.emissions(c, code, counts[code])
            own, sums = counts[code, :-1].astype(np.float32), np.concatenate([moved.ravel(), begun, by_count(counts, c).ravel()])
            ends, rows = np.cumsum(words.column("often").to_numpy()), []
            for row in words.select(["of", "share", "n", "c", "often", "id"]).to_pylist():
                hi = ends[len(rows)]
                rows.append((*row.values(), pressed(own[hi - row["often"] : hi], np.float32), None if rows else sums))
            return dealt(rows, "own")

        return count

    def summed(table):
        share, often = table.column("share")[0].as_py(), table.column("often").to_pylist()
        ids = cells_of(table, "id", np.int32, often)
        of = np.concatenate(ids)
        own = np.concatenate(cells_of(table, "own", np.float32, [n * (states - 1) for n in often])).reshape(len(of), states - 1)
        total = np.zeros((of.max(initial=-1) + 1, states - 1))
        for k in range(states - 1):
            total[:, k] = np.bincount(of, weights=own[:, k])
        sums = sum((np.array(x) for x in table.column("sums").to_pylist() if x is not None), np.zeros((states + 1 + RARE) * states))
        rows = [(None, share, 0, None, 0, None, None, np.concatenate([sums, total.sum(0)]))]
        total = total.astype(np.float32)
        for row, i in zip(table.select(["block", "share", "n", "c", "often", "id"]).to_pylist(), ids, strict=True):
            rows.append((*row.values(), pressed(total[i], np.float32), None))
        return dealt(rows, "own")

    for turn in range(passes if n_train else 0):
        made = stored(joined(known).applyInArrow(counting(model, 1 if turn else max(1, start_rounds)), DEALT.format(own="own")), "returned")
        discard(known)
        known = stored(made.groupBy("share").applyInArrow(summed, DEALT.format(own="own")), "counts")
        discard(made)
        sums = added(known)
        sums = np.array([sums[k] for k in range((states + 2 + RARE) * states - 1)])
        lines, used = sums[: 1 - states or None].reshape(-1, states), sums[len(sums) + 1 - states :]
        model = Model(np.append(used, max(0.0, often - used.sum())), lines[states + 1 :], sizes, lines[:states], lines[states], n_train)
    base_unit = n_train + 0.1 * (n_words + 1)

    def scored(block, words):
        import pyarrow as pa

        _, codes, length, c, _, emit = opened(block, words, model)
        start = np.cumsum(length) - length
        base = np.add.reduceat(np.log10((c + 0.1) / base_unit)[codes], start)
        known = np.add.reduceat((c > 0).astype(np.int64)[codes], start)
        score = log_likelihoods(codes, start, length, emit, model.moves, model.first)
        ids, held = (block.column(n)[0].values for n in ("doc_id", "held_out"))
        return pa.table([ids, held, pa.array(length, pa.int64()), pa.array(known), pa.array(np.full(len(length), n_train, np.int64)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return joined(known, "doc_id").applyInArrow(scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op11_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))
