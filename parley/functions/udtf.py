"""Table function over tagged transcripts, for use from SQL."""

from parley.functions.tagged import SPEAKER_TAG, SPECIAL
from parley.functions.text import EDGE_SPACE

#: ``tagged.parse_events`` as SQL: pieces that start at a speaker tag, each cut at its event tokens.
_EVENTS = f"""
flatten(transform(split(tagged, r'(?={SPEAKER_TAG})'), run -> filter(transform(
  split(regexp_replace(run, r'^{SPEAKER_TAG}', ''), r'(?<={SPECIAL})|(?={SPECIAL})'),
  piece -> CASE WHEN piece RLIKE r'^{SPECIAL}$'
    THEN named_struct('kind', 'special', 'speaker', CAST(NULL AS STRING), 'value', piece)
    ELSE named_struct('kind', 'text', 'speaker', nullif(regexp_extract(run, r'^<(speaker_[AB])>', 1), ''),
                      'value', regexp_replace(piece, r'{EDGE_SPACE}', '')) END),
  event -> event.value <> '')))"""


def register(spark):
    """Register ``tagged_events``: ``SELECT * FROM t, LATERAL tagged_events(t.text)``."""
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION tagged_events(tagged STRING)
        RETURNS TABLE (pos INT, kind STRING, speaker STRING, value STRING)
        RETURN SELECT at, event.kind, event.speaker, event.value
        FROM (SELECT posexplode({_EVENTS}) AS (at, event))"""
    )
