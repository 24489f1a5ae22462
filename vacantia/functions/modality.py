"""Modality of coordinated clauses, as Column expressions.

A sentence is cut into members before each joint: hard ones (``;``, line breaks, *but*, *aber*, ...) begin a new clause, soft
ones (commas, *and*, *oder*, *nor*, *noch*, ...) a coordinated member of the same clause.  A member's own marker says waived, optional or required.

* A marker behind the member's subject also governs the unmarked members before it, back to the last marked one.
* A marker in front of it ("Preferred are ...", "Idealerweise ...") governs the unmarked members after it.
* *No*, *kein*, *neither*, *weder* open a negative list, which *nor*, *noch*, *or*, *oder* and unmarked members carry on; a
  member of it that is required, or not marked, is waived.

What nothing governs is required.  Null and empty sentences have no members.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wording of waivers, preferences, requirements and joints.
WAIVERS = r"\b(?:not|nicht|never)\s+(?:strictly\s+|zwingend\s+|a\s+)?(?:required|necessary|mandatory|essential|needed|requirement|prerequisite|erforderlich|notwendig|vorausgesetzt|verlangt|gefordert|verpflichtend)\b|\bkein\w*\s+(?:zwingende\s+)?voraussetzung\b"
PREFERENCES = r"\b(?:optional|preferred|preferably|desired|nice.to.have|idealerweise|wünschenswert|bevorzugt|willkommen|von vorteil|a plus|an? advantage|beneficial)\b"
DEMANDS = r"\b(?:required|requires?|necessary|mandatory|essential|needed|must|erforderlich|notwendig|vorausgesetzt|verlangt|voraussetzung|zwingend)\b"
NEGATIVES = r"^(?:no|kein\w*|neither|weder)\b"
HARD = r"[;\n]|(?:but|aber|while|whereas|jedoch|sondern)\b"
SOFT = r",\s|(?:and|und|or|oder|sowie|nor|noch)\b"
NEGATIVE_JOINTS = r"(?:nor|noch)\b"
ALTERNATIVES = r"(?:or|oder)\b"

MEMBER = "struct<s:int,e:int,modality:string>"


def members(sentence: Column) -> Column:
    """array<struct<s, e, modality>>: the members of a sentence by character (from 0, end exclusive), which together are the sentence."""
    pieces = F.filter(F.split(F.coalesce(sentence, F.lit("")), r"(?i)(?=[;\n]|,\s|\b(?:but|aber|while|whereas|jedoch|sondern|and|und|or|oder|sowie|nor|noch)\b)"), lambda p: p != "")

    def described(p: Column) -> Column:
        joint = F.regexp_extract(p, rf"(?i)^(?:{HARD}|{SOFT})", 0)
        body = F.lower(F.trim(F.substring(p, F.length(joint) + 1, F.length(p))))
        own = F.when(body.rlike("(?i)" + WAIVERS), "waived").when(body.rlike("(?i)" + PREFERENCES), "optional").when(body.rlike("(?i)" + DEMANDS), "required")
        return F.struct(
            F.length(p).alias("n"), own.alias("own"), body.rlike(rf"(?i)^(?:{PREFERENCES}|{DEMANDS})").alias("leads"), body.rlike(NEGATIVES).alias("negative"),
            joint.rlike(f"(?i)^(?:{HARD})").alias("hard"), joint.rlike(f"(?i)^{NEGATIVE_JOINTS}").alias("nor"), joint.rlike(f"(?i)^{ALTERNATIVES}").alias("either"),
        )

    none = F.lit(None).cast("string")
    rows = "array<struct<s:int,e:int,own:string,lead:string,list:boolean,hard:boolean,leads:boolean>>"

    def forward(a: Column, m: Column) -> Column:
        lead = F.when(m["leads"], m["own"]).when(m["hard"], none).when(m["own"].isNotNull(), none).otherwise(a["lead"])
        negative = m["negative"] | m["nor"] | (~m["hard"] & a["list"] & (m["either"] | m["own"].isNull()))
        row = F.struct(a["at"].alias("s"), (a["at"] + m["n"]).alias("e"), m["own"].alias("own"), lead.alias("lead"), negative.alias("list"), m["hard"].alias("hard"), m["leads"].alias("leads"))
        return F.struct((a["at"] + m["n"]).alias("at"), lead.alias("lead"), negative.alias("list"), F.concat(a["rows"], F.array(row)).alias("rows"))

    start = F.struct(F.lit(0).alias("at"), none.alias("lead"), F.lit(False).alias("list"), F.from_json(F.lit("[]"), rows).alias("rows"))
    read = F.aggregate(F.transform(pieces, described), start, forward, lambda a: a["rows"])

    def backward(a: Column, m: Column) -> Column:
        governs = F.coalesce(m["own"], a["trail"])  # from the right, within the clause
        says = F.coalesce(m["own"], F.when(m["lead"].isNotNull(), m["lead"]), a["trail"], F.lit("required"))
        says = F.when(m["list"] & (says == "required"), "waived").otherwise(says)
        trail = F.when(m["hard"] | m["leads"], none).otherwise(governs)
        return F.struct(trail.alias("trail"), F.concat(F.array(F.struct(m["s"].alias("s"), m["e"].alias("e"), says.alias("modality"))), a["rows"]).alias("rows"))

    return F.aggregate(F.reverse(read), F.struct(none.alias("trail"), F.from_json(F.lit("[]"), f"array<{MEMBER}>").alias("rows")), backward, lambda a: a["rows"])


def modality_at(parts: Column, place: Column | int) -> Column:
    """The modality of the member that holds a character; null outside."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.try_element_at(F.filter(parts, lambda m: (m["s"] <= at) & (at < m["e"])), F.lit(1))["modality"]


def modality_of(sentence: Column, term: Column | str) -> Column:
    """The modality of the first occurrence of ``term`` in a sentence; null if it does not occur."""
    text = F.lit(term) if isinstance(term, str) else term
    return modality_at(members(sentence), F.nullif(F.position(text, sentence), F.lit(0)) - 1)
