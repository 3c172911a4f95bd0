"""Word lists, tables, constants and patterns the results depend on."""

# Task keys.
REACTION_TASKS = ("HER", "OER", "ORR", "HOR", "UOR", "EOR", "HZOR", "O5H", "CO2RR")
MATERIAL_TASKS = (
    "photothermal_conversion_efficiency",
    "conductivity",
    "thermal_conductivity",
    "ferromagnetism",
    "ferrimagnetism",
    "antiferromagnetism",
    "photocatalytic_h2o2",
    "antibacterial",
    "thermoelectric",
    "furfural_hydrogenation",
)
TASKS = REACTION_TASKS + MATERIAL_TASKS
FAMILY_REACTION = "reaction"
FAMILY_MATERIAL = "material_property"
FAMILY_GLOBAL = "global"

# One metric and unit per task.
TASK_METRICS = {
    "HER": ("overpotential_10mAcm-2", "mV"),
    "OER": ("overpotential_10mAcm-2", "mV"),
    "ORR": ("half_wave_potential", "V"),
    "HOR": ("exchange_current_density", "mA cm-2"),
    "UOR": ("potential_10mAcm-2", "V"),
    "EOR": ("mass_activity", "A mg-1"),
    "HZOR": ("overpotential_10mAcm-2", "mV"),
    "O5H": ("faradaic_efficiency", "fraction_0_to_1"),
    "CO2RR": ("partial_current_density", "mA cm-2"),
    "photothermal_conversion_efficiency": ("photothermal_conversion_efficiency", "%"),
    "conductivity": ("conductivity", "S/m"),
    "thermal_conductivity": ("thermal_conductivity", "W m-1 K-1"),
    "ferromagnetism": ("saturation_magnetization", "emu/g"),
    "ferrimagnetism": ("saturation_magnetization", "emu/g"),
    "antiferromagnetism": ("neel_temperature", "K"),
    "photocatalytic_h2o2": ("apparent_quantum_efficiency", "%"),
    "antibacterial": ("minimum_concentration", "ppm"),
    "thermoelectric": ("figure_of_merit", "dimensionless"),
    "furfural_hydrogenation": ("furfuryl_alcohol_yield", "%"),
}

# Source file of each task.
FILE_TASKS = {
    "batch_1__co2rr_1431.jsonl": "CO2RR",
    "batch_1__eor_76.jsonl": "EOR",
    "batch_1__her_2945.jsonl": "HER",
    "batch_1__hor_87.jsonl": "HOR",
    "batch_1__hzor_72.jsonl": "HZOR",
    "batch_1__o5h_59.jsonl": "O5H",
    "batch_1__oer_219.jsonl": "OER",
    "batch_1__orr_240.jsonl": "ORR",
    "batch_1__uor_92.jsonl": "UOR",
    "batch_2__Antiferromagnetism_1134.jsonl": "antiferromagnetism",
    "batch_2__Conductivity_1457.jsonl": "conductivity",
    "batch_2__Ferrimagnetism_66.jsonl": "ferrimagnetism",
    "batch_2__Ferromagnetism_835.jsonl": "ferromagnetism",
    "batch_2__Photothermal_conversion_efficiency_1516.jsonl": "photothermal_conversion_efficiency",
    "batch_2__Thermal_Conductivity_1245.jsonl": "thermal_conductivity",
    "batch_3__光催化h2o2_1585.jsonl": "photocatalytic_h2o2",
    "batch_3__抑菌_2886.jsonl": "antibacterial",
    "batch_3__热电_1696.jsonl": "thermoelectric",
    "batch_3__糠醛加氢_461.jsonl": "furfural_hydrogenation",
}

# Task spellings of the feedback records (folded key -> task).
TASK_ALIASES = {
    "hzor": "HZOR",
    "hydrazine oxidation": "HZOR",
    "hydrazine oxidation reaction": "HZOR",
    "photothermal": "photothermal_conversion_efficiency",
    "photothermal conversion efficiency": "photothermal_conversion_efficiency",
    "electrical conductivity": "conductivity",
    "thermal conductivity": "thermal_conductivity",
    "ferromagnetic": "ferromagnetism",
    "ferrimagnetic": "ferrimagnetism",
    "antiferromagnetic": "antiferromagnetism",
    "anti ferromagnetism": "antiferromagnetism",
    "photocatalytic h2o2": "photocatalytic_h2o2",
    "photocatalytic hydrogen peroxide": "photocatalytic_h2o2",
    "h2o2 photocatalysis": "photocatalytic_h2o2",
    "antimicrobial": "antibacterial",
    "bactericidal": "antibacterial",
    "thermoelectricity": "thermoelectric",
    "zt": "thermoelectric",
    "furfural hydrogenation": "furfural_hydrogenation",
    "furfuryl alcohol": "furfural_hydrogenation",
    "光热转换效率": "photothermal_conversion_efficiency",
    "电导率": "conductivity",
    "热导率": "thermal_conductivity",
    "铁磁性": "ferromagnetism",
    "亚铁磁性": "ferrimagnetism",
    "反铁磁性": "antiferromagnetism",
    "光催化h2o2": "photocatalytic_h2o2",
    "抑菌": "antibacterial",
    "热电": "thermoelectric",
    "糠醛加氢": "furfural_hydrogenation",
}

# Reaction spellings of experimental tables and of notes.
REACTION_ALIASES = {
    "hydrogen evolution": "HER",
    "hydrogen evolution reaction": "HER",
    "oxygen evolution": "OER",
    "oxygen evolution reaction": "OER",
    "oxygen reduction": "ORR",
    "oxygen reduction reaction": "ORR",
    "hydrogen oxidation": "HOR",
    "hydrogen oxidation reaction": "HOR",
    "urea oxidation": "UOR",
    "urea oxidation reaction": "UOR",
    "ethanol oxidation": "EOR",
    "ethanol oxidation reaction": "EOR",
    "co2 reduction": "CO2RR",
    "co2 reduction reaction": "CO2RR",
    "carbon dioxide reduction": "CO2RR",
    "carbon dioxide reduction reaction": "CO2RR",
    "析氢": "HER",
    "氢析出": "HER",
    "析氧": "OER",
    "氧析出": "OER",
    "氧还原": "ORR",
    "氢氧化": "HOR",
    "氢氧化反应": "HOR",
    "尿素氧化": "UOR",
    "乙醇氧化": "EOR",
    "联氨氧化": "HZOR",
    "肼氧化": "HZOR",
    "co2rr反应": "CO2RR",
    "co2还原": "CO2RR",
    "co2电还原": "CO2RR",
    "hmf氧化": "O5H",
    "5-hmf氧化": "O5H",
    "5羟甲基糠醛氧化": "O5H",
    "5-羟甲基糠醛氧化": "O5H",
    "5羟甲基糠醛电氧化": "O5H",
    "5-羟甲基糠醛电氧化": "O5H",
}

# Task spellings in the index metadata.
INDEX_TASK_ALIASES = {
    "photothermal conversion efficiency": "photothermal_conversion_efficiency",
    "thermal conductivity": "thermal_conductivity",
    "hydrogenation of furfural": "furfural_hydrogenation",
    "photocatalytic h2o2 production": "photocatalytic_h2o2",
}

# Metric columns of the flat property table.
PROPERTY_METRIC_KEYS = {
    "antiferromagnetism": "neel_temperature",
    "conductivity": "conductivity",
    "ferrimagnetism": "saturation_magnetization",
    "ferromagnetism": "saturation_magnetization",
    "photothermal_conversion_efficiency": "photothermal_conversion_efficiency",
    "thermal_conductivity": "thermal_conductivity",
}

# Metrics in scope per reaction.
REACTION_METRICS = {
    "HER": ("overpotential_10mAcm-2",),
    "OER": ("overpotential_10mAcm-2",),
    "ORR": ("half_wave_potential",),
    "HOR": ("exchange_current_density",),
    "UOR": ("potential_10mAcm-2",),
    "EOR": ("mass_activity",),
    "HZOR": ("overpotential_10mAcm-2",),
    "O5H": ("faradaic_efficiency",),
    "CO2RR": ("faradaic_efficiency", "partial_current_density"),
}

# Accepted unit suffixes of established truth values (spaces removed, lower case).
TRUTH_UNITS = {
    "antiferromagnetism": ("k",),
    "conductivity": ("scm-1", "s/cm", "sm-1", "s/m", "mscm-1", "ms/cm", "msm-1", "ms/m"),
    "ferrimagnetism": ("emu/g",),
    "ferromagnetism": ("emu/g",),
    "photothermal_conversion_efficiency": ("%",),
    "thermal_conductivity": ("wm-1k-1",),
}
UNITLESS_METRICS = ("faradaic_efficiency", "hmf_conversion", "fdca_yield")

# Names that do not identify a material.
GENERIC_NAMES = (
    "", "-", "n/a", "na", "none", "not specified", "unknown", "unspecified", "material", "the material",
    "sample", "the sample", "catalyst", "the catalyst", "photocatalyst", "electrocatalyst", "composite",
    "nanocomposite", "nanoparticle", "nanoparticles",
)
GENERIC_NAME_PATTERN = r"^(?:the\s+)?(?:prepared\s+|synthesized\s+)?(?:material|sample|catalyst)s?$"

# Patterns of vague names.
ANONYMOUS_NAME_PATTERN = r"(?i)^\s*(?:sample|material|compound|catalyst)?\s*\(?\s*(?:[ivx]{1,5}|\d+[a-z]?)\s*\)?\s*$"
COLLECTIVE_PATTERN = r"(?i)\b(?:series|family|various|different|several|multiple|assorted|range)\b"
UNSPECIFIED_PATTERN = (
    r"(?i)\b(?:transition|rare[- ]earth)\s+metal(?:s|\s+ions|\s+elements)?\b"
    r"|\b(?:various|different|multiple|unspecified)\s+(?:metal\s+)?(?:ions|elements|dopants)\b"
)
GROUP_PATTERN = (
    r"(?i)\b(?:materials?|catalysts?|composites?|compounds?|semiconductors?)\s+(?:with|containing|based on)\b"
    r"|\b\w+[- ]based\s+(?:materials?|catalysts?|composites?|compounds?|semiconductors?)\b"
)
VARIABLE_FORMULA_PATTERN = r"(?:\d|\))[+-]?[xyz](?:\b|(?=[A-Z]))|\b[xyz]\s*(?:=|<|>|<=|>=|≤|≥)"
VARIABLE_SCOPE_PATTERN = (
    r"(?i)\b(?:series|various|different|range|compositions?|concentrations?)\b|\b[xyz]\s*(?:=|<|>|≤|≥)"
)

# The chemical elements by atomic number.
ELEMENTS = (
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca", "Sc", "Ti", "V", "Cr", "Mn", "Fe",
    "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y", "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn",
    "Sb", "Te", "I", "Xe", "Cs", "Ba", "La", "Ce", "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Hf", "Ta", "W",
    "Re", "Os", "Ir", "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn", "Fr", "Ra", "Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm", "Bk", "Cf",
    "Es", "Fm", "Md", "No", "Lr", "Rf", "Db", "Sg", "Bh", "Hs", "Mt", "Ds", "Rg", "Cn", "Nh", "Fl", "Mc", "Lv", "Ts", "Og",
)
NON_METALS = (
    "H", "He", "B", "C", "N", "O", "F", "Ne", "Si", "P", "S", "Cl", "Ar", "Ge", "As", "Se", "Br", "Kr", "Sb", "Te", "I", "Xe", "At", "Rn", "Ts",
    "Og",
)
SUPPORT_ELEMENTS = ("H", "O", "C", "N", "S", "P", "F", "Cl", "Br", "I", "K", "Na", "Li")

# Element names written out.
ELEMENT_NAMES = {
    "aluminium": "Al", "aluminum": "Al", "antimony": "Sb", "arsenic": "As", "barium": "Ba", "bismuth": "Bi",
    "cadmium": "Cd", "calcium": "Ca", "cerium": "Ce", "chromium": "Cr", "cobalt": "Co", "copper": "Cu",
    "gallium": "Ga", "gold": "Au", "hafnium": "Hf", "indium": "In", "iridium": "Ir", "iron": "Fe",
    "lanthanum": "La", "lead": "Pb", "lithium": "Li", "magnesium": "Mg", "manganese": "Mn", "mercury": "Hg",
    "molybdenum": "Mo", "nickel": "Ni", "niobium": "Nb", "osmium": "Os", "palladium": "Pd", "platinum": "Pt",
    "potassium": "K", "rhenium": "Re", "rhodium": "Rh", "ruthenium": "Ru", "silver": "Ag", "sodium": "Na",
    "strontium": "Sr", "tantalum": "Ta", "tin": "Sn", "titanium": "Ti", "tungsten": "W", "vanadium": "V",
    "zinc": "Zn", "zirconium": "Zr",
}

# Product labels.
PRODUCT_ALIASES = {
    "co": "CO", "carbon monoxide": "CO", "hcooh": "HCOOH", "hcoo-": "HCOOH", "hcoo−": "HCOOH", "hcoo": "HCOOH",
    "formic acid": "HCOOH", "formate": "HCOOH", "c2h4": "C2H4", "ethylene": "C2H4", "ethene": "C2H4",
    "c2h5oh": "C2H5OH", "ethanol": "C2H5OH", "ch4": "CH4", "methane": "CH4", "ch3cooh": "CH3COOH",
    "acetic acid": "CH3COOH", "acetate": "CH3COOH", "c2+": "C2+", "c2 products": "C2+", "c2": "C2+",
    "multi-carbon products": "C2+", "multi-carbon": "C2+", "c3+": "C3+", "n-propanol": "C3+",
}
TRUTH_PRODUCTS = ("CO", "HCOOH", "CH4", "C2H5OH", "C2H4", "CH3COOH")
PRODUCT_PATTERNS = (
    ("CH3COOH", r"(?i)\bCH3COOH\b|\bacetate\b|\bacetic\s+acid\b"),
    ("C2H5OH", r"(?i)\bC2H5OH\b|\bethanol\b"),
    ("C2H4", r"(?i)\bC2H4\b|\bethylene\b"),
    ("HCOOH", r"(?i)\bHCOOH\b|\bHCOO-?\b|\bformate\b|\bformic\s+acid\b"),
    ("CH4", r"(?i)\bCH4\b|\bmethane\b"),
    ("C2+", r"(?i)(?<![A-Za-z0-9])C2\+(?![A-Za-z0-9])|\bC2\+\s*products?\b"),
    ("C3+", r"(?i)(?<![A-Za-z0-9])C3\+(?![A-Za-z0-9])|\bC3\+\s*products?\b"),
    ("CO", r"(?i)\bCO\b|\bcarbon\s+monoxide\b"),
)

# Grades and their bounds, best first.
GRADES = ("Outstanding", "Good", "Fair", "Poor", "Terrible")
LOWER_IS_BETTER = {
    "HER": (50.0, 150.0, 200.0, 250.0),
    "OER": (200.0, 270.0, 350.0, 400.0),
    "UOR": (1.3, 1.4, 1.45, 1.6),
    "HZOR": (-50.0, 0.0, 100.0, 200.0),
    "antibacterial": (10.0, 50.0, 100.0, 500.0),
}
HIGHER_IS_BETTER = {
    "ORR": (0.92, 0.85, 0.75, 0.65),
    "HOR": (3.0, 1.5, 1.0, 0.65),
    "EOR": (20.0, 5.0, 1.0, 0.5),
    "O5H": (95.0, 90.0, 85.0, 80.0),
    "photothermal_conversion_efficiency": (90.0, 70.0, 50.0, 20.0),
    "conductivity": (1.0e7, 1.0e6, 1.0e4, 1.0e-2),
    "thermal_conductivity": (400.0, 200.0, 50.0, 1.0),
    "ferromagnetism": (200.0, 150.0, 50.0, 20.0),
    "ferrimagnetism": (100.0, 50.0, 10.0, 1.0),
    "antiferromagnetism": (600.0, 400.0, 300.0, 100.0),
    "photocatalytic_h2o2": (30.0, 10.0, 2.0, 0.5),
    "furfural_hydrogenation": (95.0, 85.0, 70.0, 60.0),
    "thermoelectric": (2.0, 1.0, 0.5, 0.1),
}
PRODUCT_EFFICIENCY = {
    "CO": (95.0, 90.0, 80.0, 75.0),
    "HCOOH": (95.0, 90.0, 80.0, 75.0),
    "CH4": (75.0, 55.0, 40.0, 35.0),
    "C2H5OH": (65.0, 50.0, 40.0, 35.0),
    "C2H4": (65.0, 50.0, 40.0, 35.0),
    "CH3COOH": (70.0, 55.0, 45.0, 40.0),
    "C2+": (80.0, 70.0, 60.0, 55.0),
    "C3+": (45.0, 30.0, 15.0, 5.0),
}
PARTIAL_CURRENT = (500.0, 100.0, 40.0, 20.0)
RANGE_LOWER_TASKS = ("HER", "OER", "UOR", "HZOR")
RANGE_HIGHER_TASKS = ("ORR", "HOR", "EOR", "O5H", "CO2RR")

# Comparators.
COMPARATORS = (">=", "<=", ">", "<", "~", "≈", "≥", "≤")
BOUND_COMPARATORS = (">", ">=", "<", "<=", "≥", "≤")

# Number and identifier patterns.
NUMBER = r"[-+]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][-+]?\d+)?"
PLAIN_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
CLAIM_NUMBER = r"[-+]?\d+(?:\.\d+)?"
COMPARATOR = r">=|<=|>|<|~|≈|≥|≤"
DOI_PREFIX = r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)"
DOI_URL = r'(?i)\b(?:https?://)?(?:dx\.)?doi\.org/(10\.\d{4,9}/[^\s<>"]+)'
DOI_LABEL = r'(?i)\bdoi\s*[:：]?\s*(10\.\d{4,9}/[^\s<>"]+)'
DOI_BARE = r'(?i)\b(10\.\d{4,9}/[^\s<>"]+)'
CITATION = r"^rag:chroma/([^/]+)/doi:([^#]+)#chunk:(\d+)$"
# Citations that normalisation leaves as they are; not all of them.
CANONICAL_CITATION = r"\Arag:chroma/[0-9A-Za-z_-]+/doi:[0-9a-z](?:[0-9a-z./-]*[0-9a-z])?#chunk:(?:0|[1-9][0-9]{0,17})\z"
CITATION_TOKEN = r"rag:chroma/[^\s;]+"
TRACE_TASK = r"\b(?:Reaction\s*Type|Target\s*reaction)\s*:\s*([A-Za-z0-9_+-]+)\b"
ACIDIC_PATTERN = (
    r"(?i)\bacidic\b|\bacidic\s+(?:conditions?|electrolyte|medium|environment)\b|\bH2SO4\b|\bHClO4\b"
    r"|\bsulfuric\s+acid\b|\bperchloric\s+acid\b|酸性|硫酸|高氯酸"
)

# Context patterns of the four free-text tasks.
WAVELENGTH = r"\b\d+(?:\.\d+)?\s*nm\b"
ORGANISM = (
    r"e\.\s*coli|s\.\s*aureus|p\.\s*aeruginosa|b\.\s*subtilis"
    r"|escherichia\s+coli|staphylococcus\s+aureus|pseudomonas\s+aeruginosa|bacillus\s+subtilis"
)
REACTION_CONDITION = r"\b\d+(?:\.\d+)?\s*(?:k|°c|c|bar|mpa|h|min)\b"
ORGANISM_PRESENT = (
    r"e\.\s*coli|s\.\s*aureus|p\.\s*aeruginosa|b\.\s*subtilis|escherichia|staphylococcus|bacteria|strain"
)
CONDITION_PRESENT = r"\b\d+(?:\.\d+)?\s*(?:k|c|°c|bar|mpa|h|min)\b|temperature|pressure|time"

# Tokens left out of keyword search and hash vectors.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "can", "could", "do", "does", "for", "from", "had", "has", "have", "if", "in", "into", "is",
    "it", "its", "may", "must", "no", "not", "of", "on", "only", "or", "our", "should", "so", "that", "the", "their", "then", "these", "this",
    "those", "to", "use", "using", "we", "when", "will", "with", "without", "you", "your",
)

# Title noise.
TITLE_NOISE = (
    "full paper", "paper", "short note", "selected paper", "research article", "research articles",
    "original article", "original research", "review article", "accepted article", "open", "open access",
    "abstract", "keywords", "keyword", "correspondence", "funding", "funding information",
    "author contributions", "acknowledgment", "acknowledgments", "acknowledgement", "acknowledgements",
    "introduction", "conclusion", "conclusions", "references", "reference", "zuschriften", "forschungsartikel",
)
TITLE_NOISE_PATTERN = (
    r"(?i)^(original|research|review)\s+article\b|^.*open\s+access.*$|^\d+(\.\d+)?\s*\|\s*\w+.*$"
    r"|^(figure|scheme|table)\b"
)

# Note cards and guideline wording.
CARD_FIELDS = {
    "TASK": "task_type",
    "RT": "reaction_type",
    "MATERIAL": "material_name",
    "ELEMENTS": "elements",
    "METALS": "components",
    "TARGET": "target_metric",
    "ANCHOR": "anchor",
    "CONTEXT": "context",
    "TAKEAWAY": "takeaway",
    "HOW_TO_USE": "how_to_use",
    "CAVEATS": "caveats",
    "APPLIES": "applies",
}
CARD_PREFIX = r"(?i)^\s*(MaterialCard|CaseCard)\s*\|\s*"
NEUTRAL_HINTS = (
    "strict json", "format", "numeric estimation", "unit discipline", "multi-metal",
    "conservative plausibility", "consistency check",
)
CHEMISTRY_WORDS = (
    "oer", "her", "orr", "hor", "uor", "eor", "hzor", "o5h", "co2rr", "overpotential", "eta10", "10 ma", "ma cm-2",
    "half-wave", "half wave", "e1/2", "exchange current", "j0", "faradaic", "fe", "rhe", "partial current",
    "mass activity", "oxide", "hydroxide", "ldh", "perovskite", "alloy", "doping", "dopant", "oxophilicity",
    "adsorption", "binding", "synergy", "catalyst", "electrode",
)
OUTPUT_FAILURE_MARKERS = (
    "failed to parse", "<answer> must", "invalid keys", "extra keys", "missing keys", "must be a number",
    "must be a non-empty", "missing or unscorable",
)

# Fields of a material input.
MATERIAL_FIELDS = (
    "material_serial_no", "material_name", "major_category", "components", "structure_relationships", "precursors",
    "feed_ratio", "preparation_method", "elements", "element_content", "conditions", "custom_prompt",
)

# Keys of a raw record that are never metrics.
NON_METRIC_KEYS = (
    "id", "metals", "reaction_type", "task_type", "material_name", "material_description", "material_input",
    "major_category", "components", "structure_relationships", "precursors", "feed_ratio", "preparation_method",
    "elements", "element_content", "conditions", "custom_prompt", "pos", "block_index", "product", "doi", "doc_id",
    "title",
)

# CSV header spellings, in order of preference.
HEADER_ALIASES = {
    "property_type": ["property_type", "property type", "task_type", "task type", "性能方向", "性能类型", "材料性能", "应用方向"],
    "reaction_type": ["reaction_type", "reaction type", "task_type", "task type", "反应类型", "反应"],
    "metals": ["metals", "metal", "金属元素", "金属", "催化剂", "组成"],
    "material_name": ["material_name", "material name", "材料名称", "样品名称", "催化剂名称"],
    "product": ["product", "products", "产物", "主要产物", "主产物"],
    "faradaic_efficiency": [
        "faradaic_efficiency", "faradaic efficiency", "fe", "co2rr_faradaic_efficiency", "法拉第效率", "产物法拉第效率",
    ],
    "faradaic_efficiency_unit": ["faradaic_efficiency_unit", "fe_unit", "法拉第效率单位", "FE单位"],
    "partial_current_density": [
        "partial_current_density", "partial current density", "j_partial", "j", "co2rr_partial_current_density",
        "部分电流密度",
    ],
    "partial_current_density_unit": [
        "partial_current_density_unit", "partial current density unit", "j_unit", "部分电流密度单位",
    ],
    "metric": ["metric", "metric_name", "指标", "指标名称", "性能指标"],
    "value": ["value", "metric_value", "指标值", "数值", "值", "指标数值"],
    "unit": ["unit", "单位"],
    "condition": ["condition", "条件", "测试条件", "电流密度条件", "current_density", "current density"],
    "notes": ["notes", "note", "备注", "说明"],
    "id": ["id", "ID", "编号", "序号", "index", "样品id", "样品ID"],
    "doi": ["doi", "DOI"],
    "title": ["title", "标题", "文献标题"],
    "recommendation_job_id": [
        "recommendation_job_id", "recommendation job id", "reco_job_id", "reco job id", "推荐任务id", "推荐任务ID",
        "推荐job_id", "推荐job id",
    ],
}
EXACT_HEADERS = ("partial_current_density", "partial_current_density_unit", "id")

# Weights of the combined product metric.
COMBINED_METRIC = "co2rr_combined"
COMBINED_WEIGHTS = {"partial_current_density": 0.5, "faradaic_efficiency": 0.5}

# Denominators added to |actual| by unit, per scoring profile.
ERROR_FLOORS = {
    "analytics": {"V": 0.05, "fraction_0_to_1": 0.05},
    "reward": {"V": 0.05, "fraction_0_to_1": 0.05, "%": 1.0, "K": 1.0, "emu/g": 1.0, "W m-1 K-1": 1.0, "S/m": 1.0},
}

# Strict extraction schemas (property -> metric field, spellings of the field).
EXTRACTION_SCHEMAS = {
    "photothermal_conversion_efficiency": (
        "photothermal_conversion_efficiency", ("Photothermal conversion efficiency", "photothermalEfficiency"),
    ),
    "conductivity": ("conductivity", ("Conductivity", "electrical_conductivity")),
    "thermal_conductivity": ("thermal_conductivity", ("Thermal Conductivity", "thermalConductivity")),
    "ferromagnetism": ("saturation_magnetization", ("Ms", "saturation magnetization", "saturationMagnetization")),
    "ferrimagnetism": ("saturation_magnetization", ("Ms", "saturation magnetization", "saturationMagnetization")),
    "antiferromagnetism": ("neel_temperature", ("Néel Temperature", "Neel Temperature", "neelTemperature")),
}
