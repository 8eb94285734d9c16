"""Fixed values.

Everything below has to keep exactly these values, because stored data, report
headers and results depend on them: control titles, column lists, aliases, word
lists, patterns and formats. No logic lives here.
"""

# Control id -> (title, entity, metric label).
CONTROLS = {
    1: ("Controle 1 - Bestelling ook in SW?", "rit", "Afwijkingen"),
    2: ("Controle 2 - Tijdig afwezig gemeld?", "rit", "Tijdig afwezig gemeld, wel op factuur"),
    3: ("Controle 3 - Routes zonder reizigers", "route", "Routes zonder reizigers"),
    4: ("Controle 4", "rit", "Geen output"),
    5: ("Controle 5", "route", "Afwijkingen"),
    7: ("Controle 7 - RDW Controle kenteken", "route", "Afwijkingen"),
    8: ("Controle 8 - Overschrijden reistijd", "rit", "Overschrijden max reistijd"),
    9: ("Controle 9 - Controle stiptheid", "rit", "Afwijkingen"),
    10: ("Controle 10 - Routekaart (optimalisatie)", "route", "Herplanning sneller"),
    11: ("Controle 11 - Emissie klasse", "rit", "Afwijkingen"),
    12: ("Controle 12 - Brandstofsoort", "rit", "Afwijkingen"),
    13: ("Controle 13", "rit", "Overzicht"),
    14: ("Controle 14 - Route overlap", "route", "Meer dan 1 route gelijktijdig in voertuig"),
    15: ("Controle 15 - Leegrijd in route", "route", "Afwijkingen"),
    16: ("Controle 16 - Indicatie rolstoel", "rit", "Afwijkingen"),
    17: ("Controle 17 - Indicatie solo", "rit", "Afwijkingen"),
    18: ("Controle 18 - Postcode controle", "rit", "Afwijkingen"),
    19: ("Controle 19 - Ritten dubbel op factuur", "rit", "Afwijkingen"),
    20: ("Controle 20 - Kosten per rit", "route", "Kosten per rit"),
    21: ("Controle 21 - Leegtijd tussen routes", "route", "Afwijkingen"),
    22: ("Controle 22 - Solo klant ook solo vervoerd?", "rit", "Afwijkingen"),
    23: ("Controle 23 - Indicatie controle", "rit", "Afwijkingen"),
    24: ("Controle 24 - Controle levering data", "rit", "Afwijkingen"),
    1001: ("Controle 1001 - Heeft client een geldig WMO profiel", "rit", "Ritten met afwijkingen"),
    1002: ("Controle 1002 - Heeft client alle indicaties", "rit", "Ritten met afwijkingen"),
    1003: ("Controle 1003 - Is juiste voertuig gestuurd", "rit", "Ritten met afwijkingen"),
    1004: ("Controle 1004 - Emissieklasse voertuigen VA ritten", "rit", "Ritten met afwijkingen"),
    1005: ("Controle 1005 - Brandstof voertuigen VA ritten", "rit", "Ritten met afwijkingen"),
    1006: ("Controle 1006 - Leeftijd voertuigen VA ritten", "rit", "Ritten met afwijkingen"),
    1007: ("Controle 1007 - Heeft vervoerder voldoende dataaangeleverd", "rit", "Ritten met afwijkingen"),
    1008: ("Controle 1008 - Solo gemarkeerde client gecombineerd", "rit", "Ritten met afwijkingen"),
}

# What an unknown control id N is called.
DEFAULT_TITLE = "Controle {}"
DEFAULT_ENTITY = "rit"
DEFAULT_METRIC = "Afwijkingen"

# Controls that report figures instead of deviations.
NON_DEVIATION_CONTROLS = [20]

# Controls that always read one dataset, whatever the run.
CONTROL_DATASET = {
    1: "ritten_detail",
    8: "ritten_detail",
    10: "routes_detail",
    11: "ritten_detail",
    1004: "va_ritten_detail",
    1005: "va_ritten_detail",
}

# Dataset names.
DETAIL_DATASETS = ["ritten_detail", "routes_detail", "kentallen_route", "va_ritten_detail", "executed_controls"]
LONG_DATASETS = {
    "ritten_controls_long": ("ritten_detail", "rit"),
    "routes_controls_long": ("routes_detail", "route"),
    "va_ritten_controls_long": ("va_ritten_detail", "va_rit"),
}

# Dataset -> table of the source system.
SOURCE_TABLES = {
    "runs": "stuurtabel2_last",
    "ritten_detail": "gecontroleerdeRittenDetail",
    "routes_detail": "gecontroleerdeRoutesDetail",
    "kentallen_route": "kentallen_route",
    "va_ritten_detail": "gecontroleerdeVARittenDetail",
    "control_catalog": "controle",
    "controls_done": "controleDone",
}
DEFAULT_SCHEMA = "facturatie"

# Names under which the run id may arrive, best first.
RUN_ID_NAMES = ["stuurtabel_id", "stuurtabelid", "stuur_tabel_id", "stuur_tabelid", "id"]

# Canonical column -> accepted aliases, best first.
ALIASES = {
    "stuurtabel_id": ["stuurtabelid"],
    "rit_id": ["ritid", "ritten_id", "rit_nr", "ritnummer"],
    "route_id": ["routeid", "route_nr", "routenummer"],
    "vervoerder": ["vervoerder_naam"],
    "perceel": ["perceelnummer"],
    "ritdatum": ["rit_datum", "datum"],
    "controlecode": ["controle_code", "controlecode_done", "controlecode_controle", "control_code"],
    "controle_uitkomst": ["uitkomst", "controle_resultaat", "controle_uitkomst_code", "resultaat"],
    "afwijkingsbedrag": ["afwijkings_bedrag", "bedrag", "deviation_amount"],
    "uitgevoerd": ["done", "is_done", "uitgevoerd_done", "executed", "completed"],
    "timestamp": ["timestamp_done", "executed_at", "done_at", "created_at", "updated_at"],
}

# Dataset -> columns coerced to a date, to a number.
DATE_COLUMNS = {
    "ritten_detail": ["datum", "ritdatum"],
    "routes_detail": ["datum"],
    "kentallen_route": ["datum"],
    "va_ritten_detail": ["datum", "ritdatum", "rit_datum"],
}
NUMBER_COLUMNS = {
    "ritten_detail": ["id", "route_id", "bedrag_ex_btw", "perceel"],
    "routes_detail": ["id", "bedrag_ex_btw"],
    "kentallen_route": ["id", "route_id"],
    "va_ritten_detail": ["id", "route_id", "bedrag_ex_btw", "perceel"],
    "executed_controls": ["controle_id", "controlecode"],
}

# Time-of-day columns; datasets hold them as seconds since midnight, named <column>_s.
TIME_COLUMNS = [
    "bestelde_vertrektijd", "bestelde_aankomsttijd", "geplande_instap_tijd", "geplande_uitstap_tijd",
    "gerealiseerde_instap_tijd", "gerealiseerde_uitstap_tijd", "netto_instap", "netto_uitstap",
    "netto_herplan_instap", "netto_herplan_uitstap", "geplande_start_tijd", "geplande_uitstap",
    "gerealiseerde_start_tijd", "gerealiseerde_uitstap",
]

# Texts that count as yes; words that mark a deviation.
TRUTHY = ["1", "true", "yes", "ja", "y"]
DEVIATION_WORDS = r"afwijk|deviat|niet|fout|overschrij"

# Patterns.
RESULT_COLUMN = r"^resultaat_(\d+)$"
LOCATION_CODE = r"^\d{5}\s+"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}$"
DUTCH_DATE_TEXT = r"^(\d{2})-(\d{2})-(\d{4})$"
TIMESTAMP_TEXT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"
CLOCK_TEXT = r"^\d{1,2}:\d{2}$"
PLAIN_NUMBER_TEXT = r"^-?\d+(\.\d+)?$"
TIME_AT_END = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?$"
WORD_BREAK = r"([a-z0-9])([A-Z])"
NOT_IN_NAMES = r"[^a-zA-Z0-9]+"

# Parts of names of columns that hold times.
TIME_NAME_PART = "tijd"
TIME_NAME_START = "netto_"
TIME_NAME_ENDS = ("_uitstap", "_instap", "_start")
NUMBER_TEXT = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"

# Every character that counts as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Plates that stand for "unknown" (compared after trimming).
PLACEHOLDER_PLATES = ["", "00-00-00", "XX-XX-XX", "-  -  -"]

# Emission classes reported under one name; client kilometre parts.
MERGED_EMISSION = {"Z/Z": "Z", "6/6": "6"}
CLIENT_KM = [
    "km_tarief", "extrakm_start", "extrakm_rolstoel", "extrakm_individueel",
    "extrakm_kleinschalig", "extrakm_personenauto", "extrakm_bus", "extrakm_voorin",
]

# Trend length in runs, page length in rows, monthly window.
TREND_RUNS = 6
PAGE_ROWS = 100
COST_MONTHS = 12

# Date and time formats of exported cells.
DATE_FORMAT = "dd-MM-yyyy"
TIME_FORMAT = "HH:mm"
TIMESTAMP_FORMAT = "dd/MM/yyyy HH:mm"
CLOCK_COLUMNS = ["bestelde_aankomsttijd", "bestelde_vertrektijd", "geplande_instap_tijd", "geplande_uitstap_tijd"]

# Report columns and their headers per control. "tekst", "controlewaarde",
# "dempelwaarde" and "resultaat" stand for the column of that control.
_RIDE = {
    "datum": "Datum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
    "route_nummer": "RouteNummer", "locatie_van": "Locatie van", "postcode_van": "Postcode van",
    "locatie_naar": "Locatie naar", "postcode_naar": "Postcode naar",
    "bestelde_vertrektijd": "Besteld vertrek", "bestelde_aankomsttijd": "Besteld aankomst",
    "geplande_instap_tijd": "Instap", "geplande_uitstap_tijd": "Uitstap",
    "netto_instap": "Netto instap", "netto_uitstap": "Netto uitstap", "vervoerder": "Vervoerder",
}
_ROUTE = {
    "datum": "Datum", "kenteken": "Kenteken", "route_nummer": "RouteNummer", "route_naam": "RouteNaam",
    "aantal_lopers": "Lopers", "aantal_rollers": "Rollers", "richting": "Richting",
    "geplande_start_tijd": "Rit plan instap", "geplande_uitstap": "Rit plan uitstap",
    "gerealiseerde_start_tijd": "Rit realisatie instap", "gerealiseerde_uitstap": "Rit realisatie uitstap",
    "vervoerder": "Vervoerder",
}
_OUTCOME = {"tekst": "Tekst", "controlewaarde": "Controlewaarde", "dempelwaarde": "Drempelwaarde"}
_VA_RIDE = {
    "rit_datum": "RitDatum", "klant_nummer": "KlantNummer", "klantnaam": "Klantnaam",
    "gerealiseerde_instap_tijd": "Instaptijd", "gerealiseerde_uitstap_tijd": "Uitstaptijd",
    "plaats_van": "Gemeentecode", "tekst": "Afwijking", "rit_status": "RitStatus", "ritnummer": "Ritnummer",
}
DEFAULT_RIDE_COLUMNS = {**_RIDE, "resultaat": "Resultaat", **_OUTCOME}
DEFAULT_ROUTE_COLUMNS = {**_ROUTE, "resultaat": "Resultaat", **_OUTCOME}
REPORT_COLUMNS = {
    2: {
        "datum": "Datum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
        "route_nummer": "RouteNummer", "locatie_van": "Locatie van", "locatie_naar": "Locatie naar",
        "bestelde_vertrektijd": "Besteld vertrek", "bestelde_aankomsttijd": "Besteld aankomst",
        "gerealiseerde_instap_tijd": "Gerealiseerde instap", "gerealiseerde_uitstap_tijd": "Gerealiseerde uitstap",
        **_OUTCOME,
    },
    3: {
        "datum": "Datum", "route_nummer": "Routenummer", "kenteken": "Kenteken",
        "postcode_eerste": "PostcodeEerste", "postcode_via": "PostcodeVia", "postcode_laatste": "PostcodeLaatste",
        "passagiers_namen": "Passagiersnamen", "geplande_start_tijd": "GeplandeStartTijd",
        "geplande_uitstap": "GeplandeUitstap", "gerealiseerde_start_tijd": "GerealiseerdeStartTijd",
        "gerealiseerde_uitstap": "GerealiseerdeUitstap", "tekst": "Routedetail",
    },
    5: {
        "datum": "Datum", "route_nummer": "RouteNummer", "route_naam": "RouteNaam", "postcode_eerste": "Van",
        "postcode_via": "Via", "postcode_laatste": "Naar", "tekst": "Foutmelding", "aantal_lopers": "Lopers",
        "aantal_rollers": "Rollers",
    },
    7: {
        "datum": "Datum", "route_nummer": "Routenummer", "kenteken": "Kenteken", "tekst": "Routedetail",
        "voertuigtype": "Voertuigtype",
    },
    9: {
        "datum": "Datum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
        "route_nummer": "RouteNummer", "locatie_van": "Locatie van", "postcode_van": "Postcode van",
        "locatie_naar": "Locatie naar", "postcode_naar": "Postcode naar", "bestelde_vertrektijd": "Besteld vertrek",
        "bestelde_aankomsttijd": "Besteld aankomst", "gerealiseerde_instap_tijd": "Instap",
        "gerealiseerde_uitstap_tijd": "Uitstap", **_OUTCOME,
    },
    12: DEFAULT_RIDE_COLUMNS,
    14: {**_ROUTE, **_OUTCOME},
    15: {
        "datum": "Datum", "route_nummer": "Routenummer", "route_naam": "Routenaam", "kenteken": "Kenteken",
        "postcode_eerste": "PostcodeEerste", "postcode_via": "PostcodeVia", "postcode_laatste": "PostcodeLaatste",
        "controlewaarde": "Minuten leeg",
    },
    16: {**_RIDE, **_OUTCOME},
    17: {**_RIDE, **_OUTCOME},
    18: {
        "datum": "Datum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
        "route_nummer": "RouteNummer", "locatie_van": "Locatie van", "straat_van": "Straat van",
        "huisnummer_van": "Huisnummer van", "postcode_van": "Postcode van", "plaats_van": "Plaats van",
        "locatie_naar": "Locatie naar", "straat_naar": "Straat naar", "huisnummer_naar": "Huisnummer naar",
        "postcode_naar": "Postcode naar", "plaats_naar": "Plaats naar", "tekst": "Omschrijving fout",
    },
    19: {**_RIDE, **_OUTCOME},
    21: DEFAULT_ROUTE_COLUMNS,
    22: {
        "datum": "Datum", "route_nummer": "Routenummer", "reiziger_naam": "Reizigersnaam",
        "gerealiseerde_instap_tijd": "Gerealiseerde instaptijd",
        "gerealiseerde_uitstap_tijd": "Gerealiseerde uitstaptijd", "kenteken": "Kenteken", "richting": "Richting",
        "route_naam": "Routenaam", "tekst": "Medepassagiers",
    },
    23: {
        "datum": "Datum", "klant_nummer": "Klantnummer", "reiziger_naam": "Reizigersnaam", "richting": "Richting",
        "status_rit": "StatusRit", "tekst": "Tekst_23",
    },
    24: DEFAULT_RIDE_COLUMNS,
    1001: {
        "rit_datum": "RitDatum", "klant_nummer": "KlantNummer", "klantnaam": "Klantnaam",
        "plaats_van": "Gemeentecode", "tekst": "Afwijking", "rit_status": "RitStatus", "ritnummer": "Ritnummer",
    },
    1002: _VA_RIDE,
    1003: {
        "rit_datum": "RitDatum", "klant_nummer": "KlantNummer", "klantnaam": "Klantnaam",
        "gerealiseerde_instap_tijd": "Instaptijd", "gerealiseerde_uitstap_tijd": "Uitstaptijd",
        "plaats_van": "Gemeentecode", "tekst": "Afwijking", "rit_status": "RitStatus", "kenteken": "Kenteken",
        "ritnummer": "Ritnummer",
    },
    1007: _VA_RIDE,
    1008: {
        "rit_datum": "RitDatum", "bestelde_vertrektijd": "Besteld", "klant_nummer": "KlantNummer",
        "klantnaam": "Klantnaam", "postcode_van": "Van", "postcode_naar": "Naar", "tekst": "Medepassagiers",
    },
}

# Columns and headers of the reports with their own page.
REPORT_1_COLUMNS = {
    "datum": "Datum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam", "locatie_van": "Locatie van",
    "postcode_van": "Postcode van", "bestelde_vertrektijd": "Vertrek", "locatie_naar": "Locatie naar",
    "postcode_naar": "Postcode naar", "bestelde_aankomsttijd": "Aankomst", "match_uitleg": "Match",
    "bedrag_ex_btw": "Ritprijs", "status_rit": "StatusRit", "route_nummer": "Routenummer",
    "perceel_vervoerder": "Perceelvervoerder",
}
REPORT_5_COLUMNS = {
    "route_date": "Datum", "route_nummer": "RouteNummer", "route_naam": "RouteNaam", "van": "Van", "via": "Via",
    "naar": "Naar", "foutmelding": "Foutmelding", "lopers": "Lopers", "rollers": "Rollers",
}
REPORT_5_RIDE_COLUMNS = {
    "datum": "Datum", "route_nummer": "RouteNummer", "bestelde_aankomsttijd": "Bestelde Aankomst",
    "bestelde_vertrektijd": "Bestelde Vertrek", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
    "locatie_van": "Locatie van", "plaats_van": "plaats_van", "locatie_naar": "Locatie naar",
    "plaats_naar": "plaats_naar", "geplande_instap_tijd": "Plan Instap", "geplande_uitstap_tijd": "Plan Uitstap",
    "afwezigheids_melding": "AfwezigheidsMelding",
}
REPORT_8_COLUMNS = {
    "datum": "Ritdatum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
    "locatie_van": "Locatie van", "locatie_naar": "Locatie naar", "geplande_instap_tijd": "Geplande Instap",
    "geplande_uitstap_tijd": "Geplande Uitstap", "max_reistijd": "Max reistijd",
    "geplande_reistijd": "Geplande reistijd", "overschrijding": "Overschrijding",
    "gerealiseerde_instap_tijd": "Realisatie in", "gerealiseerde_uitstap_tijd": "Realisatie uit",
    "real_reistijd": "RealReisTijd",
}
REPORT_10_COLUMNS = {
    "datum": "Datum", "klant_nummer": "KlantNummer", "reiziger_naam": "ReizigerNaam",
    "geplande_instap_tijd": "Geplande instap", "locatie_van": "Locatie van", "postcode_van": "Postcode van",
    "geplande_uitstap_tijd": "Geplande uitstap", "locatie_naar": "Locatie naar", "postcode_naar": "Postcode naar",
    "geplande_reistijd": "Geplande reistijd", "bestelde_aankomsttijd": "Besteld aankomst",
    "bestelde_vertrektijd": "Besteld vertrek", "netto_instap": "Netto instap", "netto_uitstap": "Netto uitstap",
    "netto_herplan_instap": "Herplan instap", "netto_herplan_uitstap": "Herplan uitstap", "vervoerder": "Vervoerder",
}
REPORT_11_COLUMNS = {
    "kenteken": "Kenteken", "emission_class": "Emissieklasse", "inzetdagen": "Inzetdagen", "routes": "Routes",
    "rides": "Ritten",
}
REPORT_11_CLASS_COLUMNS = {
    "emission_class": "Emissieklasse", "vehicles": "Aantal voertuigen", "ride_percentage": "Aandeel ritten",
    "client_km": "clientKM", "client_km_percentage": "Aandeel clientKM",
}
VEHICLE_AGE_COLUMNS = {
    "kenteken": "Kenteken", "inzetdagen": "Inzetdagen", "vervoerde_passagiers": "Vervoerde passagiers",
    "drempelwaarde": "Drempelwaarde", "controlewaarde": "Controlewaarde", "type": "Type", "inrichting": "inrichting",
}
REPORT_20_COLUMNS = {"datum": "Datum", "n_ritten": "Aantal ritten", "kosten_rit": "Gewogen kosten per rit"}

# Labels of the stacked fleet exports and of the totals line.
STACKED_LABELS = {
    1004: ("Voertuigen per ISO week", "Ritten per emissieniveau", "Afgelegde reizigers kilometers per emissieniveau"),
    1005: ("Voertuigen per ISO week", "Ritten per brandstoftype", "Afgelegde reizigers kilometers per brandstoftype"),
}
STACKED_HEADERS = ("Type", "Dimensie", "Totaal", "Percentage")
TOTAL_LABEL = "Totaal"
SUMMARY_HEADERS = {
    "control_id": "Control number", "control_name": "Control name", "total_checked": "Total checked",
    "total_deviations": "Total deviations", "deviation_percentage": "Deviation %",
}

# Grouped vehicle lists of controls 1004 to 1006.
GROUPED_COLUMNS = {
    1004: {"kenteken": "Kenteken", "controlewaarde_1004": "Emissieniveau", "aantal_ritten": "Aantal ritten"},
    1005: {"kenteken": "Kenteken", "controlewaarde_1005": "Brandstof", "aantal_ritten": "Aantal ritten"},
    1006: {
        "kenteken": "Kenteken", "rit_datum": "RitDatum", "controlewaarde_1006": "Leeftijd voertuig",
        "aantal_ritten": "Aantal gereden ritten", "dempelwaarde_1006": "Max leeftijd",
    },
}
