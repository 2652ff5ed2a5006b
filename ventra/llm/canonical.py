"""Free-entered values to the closest entry of a canonical list, by a partition-based similarity join in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import durable

#: What people write around a value: lead-ins, then remarks, numbers and marks after it.
LEAD = r"^(beh(aviou?r)?: *|[0-9]+[_.] *|long +|[*]+)"
TRAIL = r"( *[(].*| *, .*| +- .*| *#? *[0-9]+ *|[?*. ]+)$"
#: Most edits of an entry of the list, by the length of its squeezed string up to this many.
MOST = 4

_SPELLED = """
with typed as (
  select distinct value from {values} where value is not null
), both as (
  select value, regexp_replace(lower(value), '[^a-z0-9]', '') whole,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(value)), '{lead}', ''), '{trail}', ''), '{trail}', ''), '[^a-z0-9]', '') stripped
  from typed
)
-- the value as it stands, and without what is written around it
select value, s, bare from both lateral view stack(2, whole, 0, stripped, 1) t as s, bare where s <> '' and (bare = 0 or stripped <> whole)
"""

_SIZED = """
with labels as (
  select min(id) id, label from {reference} where label is not null group by label
), refs as (
  -- entries, their past forms, and other wordings; without blanks and marks
  select id, regexp_replace(lower(label), '[^a-z0-9]', '') squeezed, 1 own from labels
  union all
  select id, regexp_replace(regexp_replace(lower(label), 'ing$', 'ed'), '[^a-z0-9]', ''), 0 from labels where lower(label) like '%ing'
  union all
  select id, regexp_replace(lower(wording), '[^a-z0-9]', ''), 0 from {wordings} where id is not null and wording is not null
), owned as (
  -- a string that names two entries belongs to the one it is the entry of, else to the first
  select squeezed r, max_by(id, struct(own, -id)) id, max(own) own, length(squeezed) l from refs where squeezed <> '' group by squeezed
)
select *, case when own = 1 then case when l <= 3 then 0 when l = 4 then 1 when l = 5 then 2 when l <= 7 then 3 else {most} end
  else case when l <= 4 then 0 when l <= 7 then 1 else 2 end end k
from owned
"""

_MAP = """
with exact as (
  select value, min_by(struct(id, r, 0 as edits), struct(bare, -own, id)) hit from {spelled} join {sized} on s = r group by value
), open_strings as (
  select distinct s, length(s) n from {spelled} left anti join exact using (value)
), segments as (
  -- k edits leave one of k + 1 segments untouched
  select r, l, k, i, div(i * l, k + 1) from_at, div((i + 1) * l, k + 1) - div(i * l, k + 1) len
  from {sized} lateral view explode(sequence(0, k)) t as i where l > k
), shapes as (
  select distinct l, k, i, from_at, len from segments
), pieces as (
  -- substrings of the value at the places where such a segment may lie
  select s, h.l, h.k, h.i, substr(s, p + 1, h.len) piece
  from (select s, n, explode(sequence(greatest(1, n - {most}), n + {most})) l from open_strings) o
  join shapes h on o.l = h.l and abs(o.n - h.l) <= h.k
  lateral view explode(sequence(greatest(0, h.from_at - h.k), h.from_at + h.k)) t as p
  where p + h.len <= n
), pairs as (
  select distinct p.s, g.r, g.k, g.id, g.own, g.l from pieces p
  join (select r, l, k, i, substr(r, from_at + 1, len) piece, id, own from segments join {sized} using (r, l, k)) g
    on p.l = g.l and p.k = g.k and p.i = g.i and p.piece = g.piece
), near as (
  select *, levenshtein(s, r, k) edits,
    aggregate(sequence(97, 122), struct(0 as more, 0 as less), (a, c) -> struct(
      a.more + greatest(0, length(r) - length(s) - length(replace(r, chr(c), '')) + length(replace(s, chr(c), ''))) as more,
      a.less + greatest(0, length(s) - length(r) - length(replace(s, chr(c), '')) + length(replace(r, chr(c), ''))) as less),
      a -> greatest(a.more, a.less)) letters
  from pairs
), close as (
  -- two slips at most: swapped letters are two edits but change no letter
  select * from near where edits >= 0 and letters <= 2
), fuzzy as (
  select value, min_by(struct(id, r, edits), struct(edits, letters, bare, -own, -l, id)) hit
  from close join {spelled} using (s) group by value
)
select value, hit.id, hit.r as matched, hit.edits from exact
union all
select value, hit.id, hit.r, hit.edits from fuzzy
"""


def _quoted(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def spellings(values: DataFrame) -> DataFrame:
    """``value, s, bare``: each different ``value`` without case, blanks and marks (``bare`` 0), and also
    without lead-ins and remarks where that differs (1); those with no letter or digit have no row."""
    return values.sparkSession.sql(_SPELLED.replace("{lead}", _quoted(LEAD)).replace("{trail}", _quoted(TRAIL)), values=values.select("value"))


def map_to_list(values: DataFrame, reference: DataFrame, wordings: DataFrame | None = None) -> DataFrame:
    """Entry of ``reference`` (``id, label``) for each different text of ``values`` (``value``).

    ``wordings`` (``id, wording``) are further strings that stand for entries, none by default; see
    ``learned_wordings``.  Returns ``value, id, matched, edits, status``: ``matched`` with the squeezed
    reference string and the number of edits, or ``unmatched`` with nulls.  A value is compared without
    case, blanks and marks, both as it stands and without lead-ins and remarks.  Candidates are found by
    the pigeonhole principle: k edits leave one of k+1 segments of the reference string intact, at most
    k places from where it was, so substrings are joined by equality and only those pairs verified.
    Ties go to fewer edits, fewer changed letters, the unstripped text, an entry over other wording,
    the longer string, the lower id.

    Null values are left out, an empty or blank text is unmatched, repeated values give one row,
    texts of any length are handled (those far longer than all entries have no candidates), labels
    that are null are ignored and repeated labels count once, with the lowest id; an empty list
    leaves all unmatched.
    """
    spark = values.sparkSession
    values = durable(values.select("value").where("value is not null").distinct())
    if wordings is None:
        wordings = spark.createDataFrame([], "id int, wording string")
    # both are read several times below
    spelled = durable(spellings(values))
    sized = durable(spark.sql(_SIZED.replace("{most}", str(MOST)), reference=reference.select("id", "label"), wordings=wordings.select("id", "wording")))
    mapped = durable(spark.sql(_MAP.replace("{most}", str(MOST)), spelled=spelled, sized=sized))
    return spark.sql(
        """select value, id, matched, edits, 'matched' status from {mapped}
        union all
        select value, null, null, null, 'unmatched' from {values} left anti join {mapped} using (value)""",
        mapped=mapped, values=values,
    )


_LEARN = """
with named as (
  select b.row_key, b.source, b.start_at, b.end_at, m.id, s.s
  from {bouts} b left join {mapped} m using (value)
    left join (select value, max_by(s, bare) s from {spelled} group by value) s on m.id is null and b.value = s.value
), placed as (
  select row_key, source, id, s, explode(array(floor(start_at / {width}), floor(end_at / {width}))) piece from named
), standing as (
  -- entries that begin or end in a piece; as many at most as the list has
  select distinct source, piece, id from placed where id is not null and piece is not null
), seen as (
  select distinct p.row_key, p.s, e.id from placed p join standing e on p.source = e.source and p.piece = e.piece where p.id is distinct from e.id
), sizes as (
  select s, count(*) n from named where s is not null group by s
), entries as (
  select id, total - coalesce(own, 0) rest from (select id, count(*) own, sum(count(*)) over () total from named group by id) where id is not null
), beside as (
  select s, id, count(*) k, sum(count(*)) over (partition by id) all_k from seen group by s, id
), scored as (
  -- how far the entry is seen beside the text more often than beside all rows that are not of it
  select s, id, k, n, (k - n * p) / sqrt(n * p * (1 - p) + 0.5) z
  from (select *, (all_k - k) / nullif(rest - n, 0) p from beside join sizes using (s) join entries using (id)) where p is not null
), ranked as (
  select s, max_by(struct(id, k, z), struct(z, -id)) best, sort_array(collect_list(z), false) zs from scored group by s
)
select best.id, s wording from ranked where best.k >= {least} and best.z >= {sure} and best.z >= {ahead} * coalesce(try_element_at(zs, 2), 0)
"""


def learned_wordings(bouts: DataFrame, mapped: DataFrame, width_s: float = 120.0, least: int = 3, sure: float = 4.5, ahead: float = 2.0) -> DataFrame:
    """Wordings that no edit distance leads to an entry (synonyms, other languages), learned from what is
    scored beside them: ``id, wording``.

    ``bouts`` (``row_key, source, start_at, end_at, value``; a source is a recording) are scored more than
    once: bouts of one behaviour overlap, are entered twice, by several people.  ``mapped`` has the
    ``value, id`` that the similarity join found.  For a text without an entry, the rows are counted that
    begin or end in the same ``width_s`` of their source as a bout of each entry; the entry is taken if
    the count is ``least`` or more, is ``sure`` standard deviations over what all other rows that are not of
    that entry lead to expect, and ``ahead`` times that of the next entry.  So remarks that go with anything stay without one.

    A hot source costs no pairs of rows: rows meet the different entries of a piece of time, as many at
    most as the list has.  Null values, times and sources are no evidence; repeated rows count each;
    no rows, or no text that is sure enough, give no wordings.
    """
    sql = _LEARN
    for name, value in (("width", width_s), ("least", least), ("sure", sure), ("ahead", ahead)):
        sql = sql.replace("{" + name + "}", repr(value))
    spelled = spellings(bouts)
    bouts = bouts.select("row_key", "source", "start_at", "end_at", "value")
    return bouts.sparkSession.sql(sql, bouts=bouts, mapped=mapped.where("id is not null").select("value", "id"), spelled=spelled)
