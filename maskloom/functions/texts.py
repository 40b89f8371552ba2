"""Names, numbers in names, and metadata text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NAME_PREFIX = "shot-"

# XML escapes (the ampersand first) and the metadata packet around a source address.
XML_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
XMP_PACKET = """<?xpacket begin="" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
    <rdf:Description rdf:about=""
      xmlns:dc="http://purl.org/dc/elements/1.1/"
      xmlns:xmp="http://ns.adobe.com/xap/1.0/">
      <dc:source>{source}</dc:source>
      <xmp:CreatorTool>{tool}</xmp:CreatorTool>
    </rdf:Description>
  </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>
"""


def xml_escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for raw, entity in XML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def xmp_packet(source: Column, tool: str = "maskloom") -> Column:
    """Dublin Core packet naming the page an image came from; a missing source is left empty."""
    head, rest = XMP_PACKET.split("{source}")
    return F.concat(F.lit(head), xml_escaped(source), F.lit(rest.replace("{tool}", tool)))


def day_prefix(day: Column, prefix: str = NAME_PREFIX) -> Column:
    return F.concat(F.lit(prefix), F.date_format(day, "yyyyMMdd"), F.lit("-"))


def document_name(day: Column, number: Column, prefix: str = NAME_PREFIX) -> Column:
    """``<prefix>YYYYMMDD-NNN``; numbers beyond 999 simply get longer."""
    return F.concat(day_prefix(day, prefix), F.format_string("%03d", number))


def sequence_number(name: Column, prefix: Column) -> Column:
    """Leading integer after the prefix; 0 when there is none."""
    tail = F.when(name.startswith(prefix), F.substr(name, F.length(prefix) + 1)).otherwise(name)
    digits = F.regexp_extract(tail, r"^[+-]?[0-9]+", 0)
    return F.coalesce(digits.try_cast("bigint"), F.lit(0))
