"""mmCIF, PDB, HHR, ProteinNet and fixed-column files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CIF_TOKEN = re.compile(r"""(?m)^;(.*?)^;|'((?:[^']|'(?=\S))*)'(?=\s|$)|"((?:[^"]|"(?=\S))*)"(?=\s|$)|(\#[^\n]*)|(\S+)""", re.S)


def cif_items(text: str) -> dict[str, list[str]]:
    """Item name -> its values, in order; single values and loops alike."""
    tokens = [(g[4] or "", next((x for x in (g[0], g[1], g[2], g[4]) if x), "")) for g in _CIF_TOKEN.findall(text) if not g[3]]
    out: dict[str, list[str]] = {}
    i = 0
    while i < len(tokens):
        bare, value = tokens[i]
        if bare.lower() == "loop_":
            i += 1
            names = []
            while i < len(tokens) and tokens[i][0].startswith("_"):
                names.append(tokens[i][0])
                i += 1
            cells = []
            while i < len(tokens) and not (tokens[i][0].startswith("_") or tokens[i][0].lower() == "loop_" or tokens[i][0].lower().startswith("data_")):
                cells.append(tokens[i][1].strip("\n"))
                i += 1
            for k, name in enumerate(names):
                out[name] = cells[k :: len(names)]
        elif bare.startswith("_") and i + 1 < len(tokens):
            out[bare] = [tokens[i + 1][1].strip("\n")]
            i += 2
        else:
            i += 1
    return out


def _header(items: dict[str, list[str]]) -> tuple[str | None, float]:
    """Earliest revision date, and the last resolution that parses (0.0 without one)."""
    dates = sorted(d for d in items.get("_pdbx_audit_revision_history.revision_date", []) if d not in (".", "?"))
    resolution = 0.0
    for key in ("_refine.ls_d_res_high", "_em_3d_reconstruction.resolution", "_reflns.d_resolution_high"):
        try:
            resolution = float(items[key][0])
        except (KeyError, IndexError, ValueError):
            continue
    return (dates[0] if dates else None), resolution


ATOMS = "file_id string, release_date string, resolution double, chain string, residue_number int, residue string, atom string, x double, y double, z double, b double"


def read_cif_atoms(files: DataFrame) -> DataFrame:
    """Atoms of the first model of each file with its date and resolution. files: source_file, value."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ATOMS.split(", ")]
        for batch in batches:
            for name, text in zip(batch["source_file"], batch["value"]):
                items = cif_items(text)
                date, resolution = _header(items)
                get = lambda k: items.get(f"_atom_site.{k}", [])  # noqa: B023, E731
                model = get("pdbx_PDB_model_num") or ["1"] * len(get("id"))
                rows = []
                for m, c, n, r, a, x, y, z, b in zip(model, get("auth_asym_id"), get("auth_seq_id"), get("label_comp_id"), get("label_atom_id"), get("Cartn_x"), get("Cartn_y"), get("Cartn_z"), get("B_iso_or_equiv")):
                    if m == model[0]:
                        rows.append((name.rsplit("/", 1)[-1].removesuffix(".cif"), date, resolution, c, int(n), r, a, float(x), float(y), float(z), float(b)))
                yield pd.DataFrame(rows, columns=names)

    return files.select("source_file", "value").mapInPandas(parse, ATOMS)


def read_pdb_atoms(files: DataFrame) -> DataFrame:
    """Atoms of the first model from fixed columns. Insertion codes are an error."""
    lines = files.select("source_file", F.posexplode(F.split("value", "\n")).alias("n", "line"))
    end = lines.filter(F.col("line").startswith("ENDMDL")).groupBy("source_file").agg(F.min("n").alias("end"))
    atom = lines.join(end, "source_file", "left").filter((F.col("end").isNull() | (F.col("n") < F.col("end"))) & F.col("line").rlike("^(ATOM|HETATM)"))
    cut = lambda a, b: F.trim(F.substring("line", a, b - a + 1))
    number = F.when(cut(27, 27) == "", cut(23, 26)).otherwise(F.raise_error(F.lit("insertion codes are not supported")).cast("string"))
    xyz = [cut(a, b).cast("double").alias(c) for a, b, c in ((31, 38, "x"), (39, 46, "y"), (47, 54, "z"))]
    return atom.select("source_file", cut(22, 22).alias("chain"), number.cast("int").alias("residue_number"), cut(18, 20).alias("residue"), cut(13, 16).alias("atom"), *xyz, cut(61, 66).cast("double").alias("b"))


def pdb_lines(serial: Column, atom: Column, residue: Column, chain: Column, number: Column, x: Column, y: Column, z: Column, b: Column) -> Column:
    """An ATOM line of exactly 80 columns."""
    name = F.when(F.length(atom) == 4, atom).otherwise(F.rpad(F.concat(F.lit(" "), atom), 4, " "))
    return F.rpad(F.concat(F.lit("ATOM  "), F.lpad(serial.cast("string"), 5, " "), F.lit(" "), name, F.lit(" "), F.lpad(residue, 3, " "), F.lit(" "), chain, F.lpad(number.cast("string"), 4, " "), F.lit("    "), F.format_string("%8.3f%8.3f%8.3f%6.2f%6.2f", x, y, z, F.lit(1.0), b), F.lit("          "), F.lpad(F.substring(atom, 1, 1), 2, " ")), 80, " ")


HITS = "source_file string, hit_index int, name string, aligned_cols int, sum_probs double, query string, hit_sequence string, indices_query array<int>, indices_hit array<int>"


def parse_hits(text: str) -> list[tuple]:
    """Hits of an HHR report: index, name, aligned columns, summed probabilities, both alignments, residue numbers."""
    out = []
    for block in re.split(r"(?m)^No (?=\d)", text)[1:]:
        lines = block.split("\n")
        name = lines[1].lstrip(">").strip()
        numbers = dict(re.findall(r"([A-Za-z_]+)=(\S+)", lines[2]))
        sides: dict[str, tuple[list[str], list[int]]] = {"Q": ([], []), "T": ([], [])}
        for line in lines[3:]:
            m = re.match(r"^([QT]) (\S+)\s+(\d+) (\S+)\s+(\d+) \(\d+\)", line)
            if m and m[2] not in ("ss_dssp", "ss_pred", "Consensus"):
                seq, idx = sides[m[1]]
                seq.append(m[4])
                n = int(m[3]) - 1
                for c in m[4]:
                    idx.append(-1 if c == "-" else n)
                    n += c != "-"
        columns = int(numbers.get("Aligned_cols", 0))
        probs = float(numbers["Sum_probs"]) if "Sum_probs" in numbers else None
        out.append((int(re.match(r"\d+", block)[0]), name, columns, probs, "".join(sides["Q"][0]), "".join(sides["T"][0]), sides["Q"][1], sides["T"][1]))
    return out


def read_hhr(files: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in HITS.split(", ")]
        for batch in batches:
            yield pd.DataFrame([(f, *hit) for f, text in zip(batch["source_file"], batch["value"]) for hit in parse_hits(text)], columns=names)

    return files.select("source_file", "value").mapInPandas(parse, HITS)


def hmm_description(text: Column) -> Column:
    """struct(id, chain, start, end, length, text) of ``id_chain/start-end mol:protein length:n text``; null without a match.

    Split at its marks: the part before the first blank at ``/``, ``_`` and ``-``, the rest at ``length:``. Identifier and
    chain are word characters, numbers are digits.
    """
    clean = F.ltrim(text, F.lit(">"))
    head, rest = F.split(clean, r"\s", 2), F.split(clean, "protein length:", 2)
    place = F.split(F.get(head, F.lit(0)), "/", 2)
    name, span = F.split(F.get(place, F.lit(0)), "_", 2), F.split(F.get(place, F.lit(1)), "-", 2)
    n, about = F.regexp_extract(F.get(rest, F.lit(1)), "^([0-9]+)", 1), F.regexp_replace(F.get(rest, F.lit(1)), "^[0-9]+ *", "")
    number = lambda c: F.when(c.rlike("^[0-9]+$"), c.cast("int"))
    word = lambda c: F.when(c.rlike(r"^\w+$"), c)
    out = F.struct(F.lower(word(F.get(name, F.lit(0)))).alias("id"), word(F.get(name, F.lit(1))).alias("chain"), number(F.get(span, F.lit(0))).alias("start"), number(F.get(span, F.lit(1))).alias("end"), number(n).alias("length"), about.alias("text"))
    return F.when(out["id"].isNotNull() & out["chain"].isNotNull() & out["start"].isNotNull() & out["end"].isNotNull() & out["length"].isNotNull(), out)


def read_obsolete(files: DataFrame) -> DataFrame:
    """(from_id, to_id) from the fixed columns of an obsolete-entry list; entries without successor are left out."""
    lines = files.select(F.explode(F.split("value", "\n")).alias("line")).filter(F.col("line").startswith("OBSLTE"))
    return lines.select(F.lower(F.trim(F.substring("line", 21, 4))).alias("from_id"), F.lower(F.trim(F.substring("line", 30, 4))).alias("to_id")).filter("to_id <> ''")


def read_release_dates(files: DataFrame) -> DataFrame:
    """(id, release_date) of a JSON map of maps; ids in upper case."""
    m = F.from_json("value", "map<string, struct<release_date: string>>")
    return files.select(F.explode(m).alias("id", "v")).select(F.upper("id").alias("id"), F.to_date("v.release_date").alias("release_date"))


def read_proteinnet(files: DataFrame) -> DataFrame:
    """(source_file, id, primary, tertiary, mask): records of ``[ID]`` sections; coordinates are scaled by 0.01."""
    rec = files.select("source_file", F.explode(F.split("value", r"\[ID\]\n")).alias("r")).filter(F.trim("r") != "")
    part = lambda name: F.regexp_extract("r", rf"(?s)\[{name}\]\n(.*?)(?=\n\[|\s*$)", 1)
    numbers = F.transform(F.split(F.trim(F.regexp_replace(part("TERTIARY"), r"\s+", " ")), " "), lambda v: F.try_to_number(v, F.lit("S99999.999")).cast("double") * 0.01)
    return rec.select("source_file", F.regexp_extract("r", r"^(\S+)", 1).alias("id"), F.trim(part("PRIMARY")).alias("primary"), numbers.alias("tertiary"), F.trim(part("MASK")).alias("mask"))


def read_bond_table(files: DataFrame) -> DataFrame:
    """(section, bond, residue, mean, stddev) of a stereo-chemical text table: sections are separated by a dash line."""
    rows = files.select(F.posexplode(F.split(F.element_at(F.split(F.col("value"), "(?m)^-\\s*$"), 1), "\n")).alias("n", "line"))
    part = F.split(F.trim("line"), r"\s+")
    return rows.filter("n > 0").filter(F.size(part) == 4).select(F.get(part, F.lit(0)).alias("bond"), F.get(part, F.lit(1)).alias("residue"), F.get(part, F.lit(2)).cast("double").alias("mean"), F.get(part, F.lit(3)).cast("double").alias("stddev"))
