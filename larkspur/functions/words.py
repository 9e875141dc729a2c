"""Street, flat and level words of the address standard, and the synonym maps built from them."""

from __future__ import annotations

# Public authority codes, as (full form, abbreviation) for street types and (code, name) for the rest, then
# informal aliases as (alias, term), which are no public codes but the choice that answers must agree with.
STREET_TYPES = (
    ("ACCESS", "ACCS"), ("AIRWALK", "AWLK"), ("ALLEY", "ALLY"), ("ALLEYWAY", "ALWY"), ("AMBLE", "AMBL"),
    ("APPROACH", "APP"), ("ARCADE", "ARC"), ("ARTERIAL", "ARTL"), ("ARTERY", "ARTY"), ("AVENUE", "AV"),
    ("BANAN", "BA"), ("BEACH", "BCH"), ("BOARDWALK", "BWLK"), ("BOULEVARD", "BVD"), ("BOULEVARDE", "BVDE"),
    ("BOUNDARY", "BDY"), ("BRACE", "BR"), ("BRANCH", "BRAN"), ("BREAK", "BRK"), ("BRETT", "BRET"), ("BRIDGE", "BDGE"),
    ("BROADWALK", "BRDWLK"), ("BROADWAY", "BDWY"), ("BUSWAY", "BSWY"), ("BYPASS", "BYPA"), ("BYWAY", "BYWY"),
    ("CAUSEWAY", "CSWY"), ("CENTRE", "CTR"), ("CENTREWAY", "CNWY"), ("CHASE", "CH"), ("CIRCLE", "CIR"),
    ("CIRCLET", "CLT"), ("CIRCUIT", "CCT"), ("CIRCUS", "CRCS"), ("CLOSE", "CL"), ("CLUSTER", "CLR"),
    ("COLONNADE", "CLDE"), ("COMMON", "CMMN"), ("COMMONS", "CMMNS"), ("CONCORD", "CNCD"), ("CONCOURSE", "CON"),
    ("CONNECTION", "CNTN"), ("CONNECTOR", "CONR"), ("COPSE", "CPS"), ("CORNER", "CNR"), ("CORSO", "CSO"),
    ("COURSE", "CRSE"), ("COURT", "CT"), ("COURTYARD", "CTYD"), ("CRESCENT", "CR"), ("CREST", "CRST"),
    ("CRIEF", "CRF"), ("CROOK", "CRK"), ("CROSS", "CRSS"), ("CROSSING", "CRSG"), ("CROSSOVER", "CRVR"),
    ("CRUISEWAY", "CUWY"), ("CUL-DE-SAC", "CSAC"), ("CUTTING", "CUTT"), ("DEVIATION", "DE"), ("DISTRIBUTOR", "DSTR"),
    ("DIVIDE", "DIV"), ("DOMAIN", "DOM"), ("DOWNS", "DWNS"), ("DRIVE", "DR"), ("DRIVEWAY", "DVWY"),
    ("EASEMENT", "ESMT"), ("ELBOW", "ELB"), ("ENTRANCE", "ENT"), ("ESPLANADE", "ESP"), ("ESTATE", "EST"),
    ("EXPRESSWAY", "EXP"), ("EXTENSION", "EXTN"), ("FAIRWAY", "FAWY"), ("FIREBREAK", "FBRK"), ("FIRELINE", "FLNE"),
    ("FIRETRACK", "FTRK"), ("FIRETRAIL", "FITR"), ("FLATS", "FLTS"), ("FOLLOW", "FOLW"), ("FOOTWAY", "FTWY"),
    ("FORESHORE", "FSHR"), ("FORMATION", "FORM"), ("FREEWAY", "FWY"), ("FRONTAGE", "FRTG"), ("FRONT", "FRNT"),
    ("GARDEN", "GDN"), ("GARDENS", "GDNS"), ("GATE", "GTE"), ("GATEWAY", "GWY"), ("GLADE", "GLDE"), ("GRANGE", "GRA"),
    ("GREEN", "GRN"), ("GROVE", "GR"), ("GULLY", "GLY"), ("HARBOUR", "HRBR"), ("HAVEN", "HVN"), ("HEATH", "HTH"),
    ("HEIGHTS", "HTS"), ("HIGHROAD", "HIRD"), ("HIGHWAY", "HWY"), ("HOLLOW", "HLLW"), ("INLET", "INLT"),
    ("INTERCHANGE", "INTG"), ("ISLAND", "ID"), ("JUNCTION", "JNC"), ("KNOLL", "KNOL"), ("LADDER", "LADR"),
    ("LANDING", "LDG"), ("LANEWAY", "LNWY"), ("LEADER", "LEDR"), ("LINKWAY", "LNKWAY"), ("LOOKOUT", "LKT"),
    ("LYNNE", "LYNN"), ("MANOR", "MANR"), ("MAZE", "MZ"), ("MEANDER", "MNDR"), ("MOTORWAY", "MTWY"), ("NORTH", "NTH"),
    ("OUTLET", "OTLT"), ("OUTLOOK", "OTLK"), ("PALMS", "PLMS"), ("PARADE", "PDE"), ("PARADISE", "PRDS"),
    ("PARKWAY", "PWY"), ("PASSAGE", "PSGE"), ("PATHWAY", "PWAY"), ("PENINSULA", "PSLA"), ("PERCH", "PRCH"),
    ("PIAZZA", "PIAZ"), ("PLACE", "PL"), ("PLAZA", "PLZA"), ("POCKET", "PKT"), ("POINT", "PNT"), ("PRECINCT", "PREC"),
    ("PROMENADE", "PROM"), ("PURSUIT", "PRST"), ("QUADRANT", "QDRT"), ("QUAY", "QY"), ("QUAYS", "QYS"),
    ("RAMBLE", "RMBL"), ("RANGE", "RNGE"), ("REACH", "RCH"), ("RESERVE", "RES"), ("RETREAT", "RTT"),
    ("RETURN", "RTN"), ("RIDGE", "RDGE"), ("RIGHT OF WAY", "ROFW"), ("RISING", "RSNG"), ("RIVER", "RVR"),
    ("ROAD", "RD"), ("ROADS", "RDS"), ("ROADWAY", "RDWY"), ("ROTARY", "RTY"), ("ROUND", "RND"), ("ROUTE", "RTE"),
    ("SERVICEWAY", "SVWY"), ("SHUNT", "SHUN"), ("SIDING", "SDNG"), ("SKYLINE", "SKLN"), ("SLOPE", "SLPE"),
    ("SOUTH", "STH"), ("SQUARE", "SQ"), ("STEPS", "STPS"), ("STRAIGHT", "STRT"), ("STRAIT", "STAI"),
    ("STRAND", "STRA"), ("STREET", "ST"), ("STRIP", "STRP"), ("SUBWAY", "SBWY"), ("TERRACE", "TCE"),
    ("THOROUGHFARE", "THFR"), ("THROUGHWAY", "THRU"), ("TOLLWAY", "TLWY"), ("TRACK", "TRK"), ("TRAIL", "TRL"),
    ("TRAMWAY", "TMWY"), ("TRAVERSE", "TVSE"), ("TRUNKWAY", "TKWY"), ("TUNNEL", "TUNL"), ("UNDERPASS", "UPAS"),
    ("VALLEY", "VLLY"), ("VIADUCT", "VIAD"), ("VIEWS", "VWS"), ("VILLAGE", "VLGE"), ("VILLA", "VLLA"),
    ("VILLAS", "VLLS"), ("VISTA", "VSTA"), ("WALKWAY", "WKWY"), ("WATERS", "WTRS"), ("WATERWAY", "WTWY"),
    ("WHARF", "WHRF"), ("WOOD", "WD"), ("WOODS", "WDS"),
)
STREET_SUFFIXES = (
    ("CN", "CENTRAL"), ("DE", "DEVIATION"), ("E", "EAST"), ("EX", "EXTENSION"), ("IN", "INNER"), ("LR", "LOWER"),
    ("ML", "MALL"), ("N", "NORTH"), ("NE", "NORTH EAST"), ("NW", "NORTH WEST"), ("OF", "OFF"), ("OP", "OVERPASS"),
    ("OT", "OUTER"), ("S", "SOUTH"), ("SE", "SOUTH EAST"), ("SW", "SOUTH WEST"), ("UP", "UPPER"), ("W", "WEST"),
)
FLAT_TYPES = (
    ("ANT", "ANTENNA"), ("APT", "APARTMENT"), ("ATM", "AUTOMATED TELLER MACHINE"), ("BBQ", "BARBECUE"),
    ("BLCK", "BLOCK"), ("BLDG", "BUILDING"), ("BNGW", "BUNGALOW"), ("BTSD", "BOATSHED"), ("CARP", "CARPARK"),
    ("CARS", "CARSPACE"), ("COOL", "COOLROOM"), ("CTGE", "COTTAGE"), ("DUPL", "DUPLEX"), ("FCTY", "FACTORY"),
    ("GRGE", "GARAGE"), ("HSE", "HOUSE"), ("KSK", "KIOSK"), ("LBBY", "LOBBY"), ("LSE", "LEASE"),
    ("MBTH", "MARINE BERTH"), ("MSNT", "MAISONETTE"), ("OFFC", "OFFICE"), ("PTHS", "PENTHOUSE"), ("RESV", "RESERVE"),
    ("RTCE", "ROOF TERRACE"), ("SE", "SUITE"), ("SEC", "SECTION"), ("SHRM", "SHOWROOM"), ("STLL", "STALL"),
    ("STOR", "STORE"), ("STR", "STRATA UNIT"), ("STU", "STUDIO"), ("SUBS", "SUBSTATION"), ("TNCY", "TENANCY"),
    ("TNHS", "TOWNHOUSE"), ("TWR", "TOWER"), ("VLLA", "VILLA"), ("VLT", "VAULT"), ("WHSE", "WAREHOUSE"),
    ("WKSH", "WORKSHOP"),
)
LEVEL_TYPES = (
    ("B", "BASEMENT"), ("FL", "FLOOR"), ("G", "GROUND"), ("L", "LEVEL"), ("LB", "LOBBY"),
    ("LG", "LOWER GROUND FLOOR"), ("M", "MEZZANINE"), ("OD", "OBSERVATION DECK"), ("P", "PARKING"), ("PDM", "PODIUM"),
    ("PLF", "PLATFORM"), ("PTHS", "PENTHOUSE"), ("RT", "ROOFTOP"), ("SB", "SUB-BASEMENT"),
    ("UG", "UPPER GROUND FLOOR"), ("UNGD", "UNDERGROUND"),
)
ALIASES = (
    ("AVE", "AVENUE"), ("CRES", "CRESCENT"), ("BLVD", "BOULEVARD"), ("CRT", "COURT"), ("DRV", "DRIVE"),
    ("TERR", "TERRACE"), ("TER", "TERRACE"), ("GRV", "GROVE"), ("LN", "LANE"), ("PKWY", "PARKWAY"), ("SQR", "SQUARE"),
    ("CIRC", "CIRCUIT"), ("RDG", "RIDGE"), ("U", "UNIT"), ("UN", "UNIT"), ("FLT", "FLAT"), ("STE", "SUITE"),
)


def synonym_groups() -> dict[str, tuple[str, ...]]:
    """Each word with its group. Later tables win where a word is in two; aliases join the group of their term."""
    groups: dict[str, list[str]] = {}
    for table in (STREET_TYPES, STREET_SUFFIXES, FLAT_TYPES, LEVEL_TYPES):
        for pair in table:
            if pair[0] != pair[1]:
                groups |= dict.fromkeys(pair, list(pair))
    for alias, term in ALIASES:
        group = groups.setdefault(term, [term])
        if alias not in group:
            group.append(alias)
        groups[alias] = group
    return {word: tuple(group) for word, group in groups.items()}


def full_forms() -> dict[str, str]:
    """Abbreviation to full form: street types, then suffixes where absent, then aliases of street types."""
    types = {short: full for full, short in STREET_TYPES}
    fulls = set(types.values())
    return {a: t for a, t in ALIASES if t in fulls} | dict(STREET_SUFFIXES) | types


SYNONYMS = synonym_groups()
FULL = full_forms()
LEVEL_WORDS = frozenset(w for pair in LEVEL_TYPES for w in pair)
FLAT_WORDS = frozenset({"UNIT", "U", "UN", "FLAT", "FLT"} | {w for pair in FLAT_TYPES for w in pair})
UNIT_WORDS = FLAT_WORDS | LEVEL_WORDS
