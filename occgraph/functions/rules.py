"""Rule data: word lists, keyword rules and category lists.

Everything here is a fixed value of the domain. The columns that apply the
rules are built in ``text.py``.
"""

# fixed values: rare-earth element symbols (lower case)
RARE_EARTH_SYMBOLS = [
    "ce", "dy", "er", "eu", "gd", "ho", "la", "lu", "nd", "pr", "pm", "sm", "sc", "tb", "tm", "yb", "y",
]
# fixed values: words that name the group as a whole, and suffixes of a symbol
GENERIC_RARE_EARTH = ["lree", "hree", "ree"]
RARE_EARTH_SUFFIXES = ["rich", "bearing", "oxide", "enriched"]

# fixed values: phrases that do not name a primary deposit type
SECONDARY_DEPOSIT_PHRASES = ["with residual enrichment", "supergene", "tailings"]

# fixed values: host rock from mineral text (all of, any of, outcome)
MINERAL_RULES = [
    (["apatite", "magnetite"], [], "igneous rock (inferred, low confidence)"),
    ([], ["fluorite"], "igneous or hydrothermal rock (inferred, low confidence)"),
    ([], ["pyrite", "chalcopyrite"], "igneous-related hydrothermal rock (inferred, low confidence)"),
    ([], ["calcite", "dolomite"], "carbonate rock (inferred, low confidence)"),
    ([], ["garnet"], "metamorphic rock (inferred, low confidence)"),
    ([], ["quartz", "feldspar", "zircon"], "felsic igneous or sedimentary rock (inferred, low confidence)"),
]
# fixed values: host rock from deposit terms, in order
# (any of these in a term, outcome if any of these minerals is listed, outcome otherwise)
DEPOSIT_RULES = [
    (["carbonatite"], [], None, "carbonatite"),
    (["alkaline igneous"], [], None, "syenite / nepheline syenite"),
    (["iron oxide-apatite"], [], None, "igneous rock (felsic to intermediate)"),
    (["other igneous"], ["apatite", "magnetite"], "igneous rock (inferred, low confidence)", "igneous rock"),
    (["metamorphic"], [], None, "gneiss / schist"),
    (["phosphorite"], [], None, "phosphorite"),
    (["black shale"], [], None, "black shale"),
    (["sedimentary", "coal"], [], None, "sedimentary rock"),
    (["bauxite"], [], None, "laterite"),
    (["placer"], [], None, "sand, gravel"),
    (["fluorite deposit"], ["apatite", "magnetite"],
     "igneous-related hydrothermal rock (inferred, low confidence)", "unclassified"),
    (["uranium deposit"], [], None, "sandstone / igneous (unspecified)"),
    (["hydrothermal fe-oxide", "iron oxide"], [], None, "igneous-related hydrothermal rock"),
]
UNCLASSIFIED = "unclassified"
LOW_CONFIDENCE_MARK = "(inferred, low confidence)"

# fixed values: rock names per lithology group
LITHOLOGY_GROUPS = {
    "carbonatite_system": [
        "carbonatite", "magnetite carbonatite", "dolomitic carbonatite", "calcite carbonatite", "calcite carbonatite lava",
        "dolomite carbonatite", "sövite", "beforsite", "rauhaugite", "weathered carbonatite",
    ],
    "alkaline_intrusive": [
        "syenite", "nepheline syenite", "syenite / nepheline syenite", "alkaline syenite", "quartz syenite",
        "peralkaline syenite", "alkaline igneous rock", "igneous rock (inferred alkaline)", "foyaite", "urtite", "ijolite",
        "melteigite", "phonolite", "alkaline granite", "peralkaline granite",
    ],
    "mafic_ultramafic": ["pyroxenite", "gabbro", "diorite", "monzonite", "intermediate intrusions", "phoscorite"],
    "felsic_pegmatite": ["granite", "biotite granite", "monzogranite", "gneissic granite", "pegmatite", "albitite"],
    "metamorphic_metasomatic": [
        "gneiss", "gneiss / schist", "schist", "mica schist", "amphibolite", "migmatite", "quartzite", "fenite",
    ],
    "sedimentary": [
        "limestone", "dolomite", "shale", "black shale", "sandstone", "siltstone", "mudstone", "conglomerate",
        "sedimentary rock", "sandstone / igneous (unspecified)", "phosphorite",
    ],
    "placer": [
        "sand", "gravel", "beach sand", "dune sand", "beach and dune sand", "dune and beach sand", "sand gravel",
        "alluvium", "alluvial sediment",
    ],
    "supergene_lateritic": ["laterite", "bauxite", "clay"],
    "unclassified": ["unclassified"],
}

# fixed values: deposit system classes, first match wins
SYSTEM_RULES = [
    ("carbonatite", ["carbonatite"]),
    ("alkaline_intrusive", ["alkaline", "alkali"]),
    ("placer", ["placer"]),
    ("clay_laterite", ["clay", "laterite", "ion adsorption", "ion-adsorption"]),
    ("pegmatite", ["pegmatite"]),
    ("vein", ["vein"]),
    ("skarn", ["skarn", "contact"]),
    ("hydrothermal", ["hydrothermal"]),
]
SYSTEM_SCRUB = "REE|rare earth|lanthanide|monazite|bastn[aä]site|xenotime|loparite|eudialyte"
SYSTEM_BLANKS = ["", "nan", "unknown"]

# fixed values: commodity symbols flagged when the entry names no rare earths
COMMODITIES = ["Nb", "Ta", "Th", "U", "P", "F", "Zr"]
COMMODITY_GUARD = r"(?i)\bREE\b|rare earth"

# fixed values: category lists of the fixed-width encoders
REGIONS = [
    "Africa", "China", "East Asia", "Europe", "Middle East", "North America", "Oceania", "Russian Federation",
    "South America", "South and Central Asia",
]
RECORD_TYPES = [
    "district or area", "district or area(?)", "intrusion or complex", "intrusion or complex(?)", "site", "site(?)",
]
SYSTEMS = [name for name, _ in SYSTEM_RULES] + ["other", "unknown"]

# fixed values: columns dropped at ingest and before model preparation
INGEST_DROP = [
    "OBJECTID", "Name_Other", "Company", "Comments", "Components", "Stat_Note", "Oth_Mins", "Ref_List", "Discov_Yr",
    "Expl_Note", "Mine_Meth", "P_Status", "PStat_Note", "P_Years", "P_refs", "P_Note", "RR_Note", "RR_RegCode", "RR_Refs",
    "RR_Yr_Est", "RR_Cutoff", "RR_oth_grd", "RR_Ore_Mt", "RR_TREO_Mt", "RR_HM_Mt", "RR_HM_pct", "RR_min_Mt", "RR_min_pct",
    "RR_mon_Mt", "RR_mon_pct", "RR_TREOgrd", "RR_REE_grd", "Dep_Note", "Dep_Form", "Part_of", "Rec_Note", "REE_Ratio",
    "Loc_Note", "Rec_Type", "LREE_Note", "HREE_Note", "REE",
]
TEXT_FIELDS = ["Comments", "Loc_Note", "Ref_List", "Rec_Note", "Dep_Note", "Stat_Note", "Expl_Note", "P_Note"]
LENGTH_FIELDS = ["Comments", "Loc_Note", "Ref_List"]
