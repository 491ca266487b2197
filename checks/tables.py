"""Spark forms of the derived tables D1..D6.

Each table is derived once per application from the driver tables, with the library's own
operators, and written to the shared scratch folder; queries read it from there.
"""

from pyspark.sql import functions as F

from checks.sql import LEXICON, SPECIALS
from parley import model as M
from parley.functions.text import is_candidate
from parley.operators.scan import Run, positions, running
from parley.session import scratch_dir

_WRITTEN = {}


def _div(a, b):
    return F.floor(a / b).cast("long")


class Tables:
    def __init__(self, spark, sf_dir):
        self.spark, self.sf = spark, sf_dir.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name):
        return self.spark.read.parquet(f"{self.sf}/{name}.parquet")

    def _stored(self, name, build):
        key = (self.spark.sparkContext.applicationId, self.sf, name)
        if key not in _WRITTEN:
            path, table = scratch_dir(self.spark, name), build()
            table.write.parquet(path)
            _WRITTEN[key] = path, table.schema
        path, schema = _WRITTEN[key]
        return self.spark.read.schema(schema).parquet(path)

    def path(self, name):
        return scratch_dir(self.spark, name)

    # D1
    def utterances(self):
        return self._stored("utterances", self._utterances)

    def _utterances(self):
        ev = self.raw("events").select(
            F.col("user_id").alias("conv_id"),
            "event_id",
            "value",
            F.unix_micros(F.col("ts").cast("timestamp")).alias("us"),
        )
        ev = positions(ev, ["conv_id"], ["us", "event_id"], x="us")
        pos, eid = F.col("pos"), F.col("event_id")
        start = pos * 1600 + (eid * 37) % 900
        words = F.array(*[F.lit(w) for w in LEXICON])
        label = F.when(eid % 11 == 0, "continuer").when(eid % 11 == 1, "assessment")
        return ev.select(
            "conv_id",
            pos.alias("utt_idx"),
            "event_id",
            F.when((eid * 7 + pos * 3) % 5 < 3, "A").otherwise("B").alias("speaker"),
            start.alias("start_ms"),
            (start + 250 + F.floor(F.col("value") * 20).cast("long") % 2600).alias("end_ms"),
            F.get(words, (eid % 12).cast("int")).alias("text"),
            label.when(eid % 11 == 2, "non_backchannel").alias("bc_label"),
        ).withColumn("n_tokens", F.length("text").cast("long"))

    # D2
    def tokens(self):
        return self._stored("tokens", self._tokens)

    def _tokens(self):
        u = self.utterances()
        i, n = F.col("tok_idx"), F.col("n_tokens")
        dur = F.col("end_ms") - F.col("start_ms")
        return u.withColumn(
            "tok_idx", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
        ).select(
            "conv_id",
            "utt_idx",
            "event_id",
            "speaker",
            "tok_idx",
            (F.col("start_ms") + _div(i * dur, n)).alias("start_ms"),
            (F.col("start_ms") + _div((i + 1) * dur, n)).alias("end_ms"),
            F.substr("text", (i + 1).cast("int"), F.lit(1)).alias("text"),
        )

    # D3
    def results(self):
        return self._stored("results", self._results)

    def _results(self):
        turns = self.raw("conversations")
        a = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ra"))
        b = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rb"))
        conv, turn = F.col("conv_id"), F.col("turn")
        marks = F.array(*[F.lit(s) for s in SPECIALS])
        mark = lambda x: F.get(marks, (x % 5).cast("int"))
        pa = F.replace("ra", F.lit("th"), F.lit("t"))
        pb = F.concat(
            F.replace("rb", F.lit("on"), F.lit("no")),
            F.when((conv + turn) % 5 == 0, "ha" * 8).otherwise(""),
        )
        tag = lambda s, c: F.concat(F.lit(f"<speaker_{s}>"), c, F.lit(f"</speaker_{s}>"))
        return a.join(b, ["conv_id", "turn"]).select(
            conv.alias("sample_id"),
            turn.alias("turn_id"),
            F.when(conv % 11 != 0, conv % 4).alias("rank"),
            F.concat(F.lit("part"), (conv % 3).cast("string")).alias("file"),
            F.concat(
                tag("A", pa),
                mark(conv + turn),
                tag("B", pb),
                mark(conv * 2 + turn),
                F.when(conv % 3 == 0, mark(turn)).otherwise(""),
            ).alias("pred"),
            F.concat(
                tag("A", F.col("ra")),
                mark(conv + turn),
                tag("B", F.col("rb")),
                mark(conv * 3 + turn),
                mark(turn),
            ).alias("ref"),
        )

    def rounds(self):
        """Streaming rounds: two turns to a sample, every fourth without a reference."""
        turns = self.raw("conversations")
        ref = F.when(F.col("turn") % 4 == 3, "").otherwise(F.col("text"))
        return turns.select(
            (F.col("conv_id") * 1000 + _div(F.col("turn"), 2)).alias("sample_idx"),
            (F.col("turn") % 2).alias("chunk_idx"),
            ref.alias("ref"),
            F.replace("text", F.lit("e"), F.lit("")).alias("pred"),
        )

    # D4
    def label_results(self):
        eid = F.col("event_id")
        labels = F.array(*[F.lit(x) for x in M.LABELS])
        base = (
            self.utterances()
            .where(is_candidate("text", F.col("end_ms") - F.col("start_ms")))
            .select(
                eid.alias("id"),
                (eid % 4).alias("rank"),
                F.when(eid % 23 == 0, F.concat("text", F.lit("x")))
                .otherwise(F.col("text"))
                .alias("text"),
                F.get(labels, (eid % 3).cast("int")).alias("label"),
                eid.alias("pos"),
            )
        )
        again = base.where("id % 17 = 0").withColumns(
            {"rank": (F.col("rank") + 1) % 4, "label": F.lit("assessment")}
        )
        return base.unionByName(again)

    # D5
    def frames(self):
        n = (F.col("event_id") + F.col("tok_idx")) % 5 + 1
        t = self.tokens().withColumn("n", n)
        t = running(
            t,
            ["conv_id", "utt_idx"],
            ["tok_idx"],
            {"before": Run("sum", F.col("n"), inclusive=False)},
            split=False,
            rows=t.agg(F.sum("n")).first()[0],
        )
        t = t.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        at = F.col("before") + F.col("j")
        return t.select(
            "conv_id",
            "utt_idx",
            F.col("tok_idx").alias("token_index"),
            at.alias("time_index"),
            (((F.col("event_id") * 7 + at * 13) % 64) / 64).alias("score"),
        )

    # D6
    def manifest(self):
        ends = self.utterances().groupBy("conv_id").agg(F.max("end_ms").alias("max_end"))
        conv, ch = F.col("conv_id"), F.col("channel")
        return (
            ends.withColumn("channel", F.explode(F.array(F.lit("A"), F.lit("B"))))
            .where(~((ch == "B") & (conv % 13 == 0)))
            .select(
                "conv_id",
                "channel",
                F.concat_ws("_", conv.cast("string"), F.lower(ch)).alias("name"),
                self._path(ch).alias("path"),
                (F.col("max_end") - (conv * 131) % 4000).alias("duration_ms"),
            )
        )

    @staticmethod
    def _path(channel):
        return F.concat(
            F.lit("/data/corpus/audios/"),
            channel,
            F.lit("_gd/"),
            F.col("conv_id").cast("string"),
            F.lit("_"),
            F.lower(channel),
            F.lit(".wav"),
        )

    def segments(self):
        return self.utterances().withColumn("path", self._path(F.col("speaker")))

    def chars(self):
        """Characters of the whole conversation texts, some without times."""
        t = self.raw("conversations").select(
            "conv_id", "turn", F.posexplode(F.split("text", "")).alias("i", "char")
        )
        i = F.col("i").cast("long")
        timed = i % 11 != 0
        return t.select(
            "conv_id",
            "turn",
            i.alias("char_idx"),
            "char",
            F.when(timed, i * 40).alias("start_ms"),
            F.when(timed, i * 40 + 35).alias("end_ms"),
            (((i * 7 + F.col("turn")) % 64) / 64).alias("score"),
        )
