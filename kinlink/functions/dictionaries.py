"""Names of places, words and abbreviations that results depend on, in the order in which they apply."""

from __future__ import annotations


def _pairs(text: str) -> list[tuple[str, str]]:
    return [tuple(x.strip() for x in line.split("=")) for line in text.replace("\n", ";").split(";") if line.strip()]  # type: ignore[misc]


def _list(text: str) -> list[str]:
    return [x.strip() for x in text.replace("\n", ";").split(";") if x.strip()]


# --- Fixed values -------------------------------------------------------------------------------------------------
US_STATES = _pairs("""
AL=Alabama; AK=Alaska; AZ=Arizona; AR=Arkansas; CA=California; CO=Colorado; CT=Connecticut; DE=Delaware; FL=Florida
GA=Georgia; HI=Hawaii; ID=Idaho; IL=Illinois; IN=Indiana; IA=Iowa; KS=Kansas; KY=Kentucky; LA=Louisiana; ME=Maine
MD=Maryland; MA=Massachusetts; MI=Michigan; MN=Minnesota; MS=Mississippi; MO=Missouri; MT=Montana; NE=Nebraska
NV=Nevada; NH=New Hampshire; NJ=New Jersey; NM=New Mexico; NY=New York; NC=North Carolina; ND=North Dakota; OH=Ohio
OK=Oklahoma; OR=Oregon; PA=Pennsylvania; RI=Rhode Island; SC=South Carolina; SD=South Dakota; TN=Tennessee; TX=Texas
UT=Utah; VT=Vermont; VA=Virginia; WA=Washington; WV=West Virginia; WI=Wisconsin; WY=Wyoming
DC=District of Columbia; PR=Puerto Rico
""")

INDIA_STATES = _list("""
Andhra Pradesh; Arunachal Pradesh; Assam; Bihar; Chhattisgarh; Goa; Gujarat; Haryana; Himachal Pradesh; Jharkhand
Karnataka; Kerala; Madhya Pradesh; Maharashtra; Manipur; Meghalaya; Mizoram; Nagaland; Odisha; Punjab; Rajasthan
Sikkim; Tamil Nadu; Telangana; Tripura; Uttar Pradesh; Uttarakhand; West Bengal; Delhi; Jammu and Kashmir; Ladakh
Puducherry; Chandigarh; Andaman and Nicobar Islands; Dadra and Nagar Haveli and Daman and Diu
""")

INDIA_CODES = _pairs("""
AP=Andhra Pradesh; AR=Arunachal Pradesh; AS=Assam; BR=Bihar; CG=Chhattisgarh; GA=Goa; GJ=Gujarat; HR=Haryana
HP=Himachal Pradesh; JH=Jharkhand; KA=Karnataka; KL=Kerala; MP=Madhya Pradesh; MH=Maharashtra; MN=Manipur
ML=Meghalaya; MZ=Mizoram; NL=Nagaland; OD=Odisha; PB=Punjab; RJ=Rajasthan; SK=Sikkim; TN=Tamil Nadu; TS=Telangana
TG=Telangana; TR=Tripura; UP=Uttar Pradesh; UK=Uttarakhand; UA=Uttarakhand; WB=West Bengal; DL=Delhi
JK=Jammu and Kashmir; LA=Ladakh; PY=Puducherry; CH=Chandigarh
""")

INDIA_ALIASES = _pairs("tamilnadu=Tamil Nadu; orissa=Odisha; uttaranchal=Uttarakhand; pondicherry=Puducherry; new delhi=Delhi")

INDIA_GATED = _pairs("""
up=Uttar Pradesh; mp=Madhya Pradesh; ap=Andhra Pradesh; tn=Tamil Nadu; wb=West Bengal; ka=Karnataka; mh=Maharashtra
dl=Delhi; nct=Delhi; rj=Rajasthan; gj=Gujarat; ts=Telangana; hr=Haryana; pb=Punjab; uk=Uttarakhand; orissa=Odisha
pondicherry=Puducherry
""")

INDIA_NATIVE = _pairs("""
ಕರ್ನಾಟಕ=Karnataka; महाराष्ट्र=Maharashtra; बिहार=Bihar; తెలంగాణ=Telangana; தமிழ்நாடு=Tamil Nadu; ગુજરાત=Gujarat
उत्तर प्रदेश=Uttar Pradesh; पश्चिम बंगाल=West Bengal; केरल=Kerala; दिल्ली=Delhi; राजस्थान=Rajasthan
मध्य प्रदेश=Madhya Pradesh; पंजाब=Punjab; हरियाणा=Haryana; ఆంధ్ర ప్రదేశ్=Andhra Pradesh; পশ্চিমবঙ্গ=West Bengal
বাংলা=West Bengal; ஒடிசா=Odisha
""")

FRANCE_REGIONS = _list("""
Auvergne-Rhone-Alpes; Bourgogne-Franche-Comte; Bretagne; Centre-Val de Loire; Corse; Grand Est; Hauts-de-France
Ile-de-France; Normandie; Nouvelle-Aquitaine; Occitanie; Pays de la Loire; Provence-Alpes-Cote d'Azur
""")

FRANCE_REGIONS_ACCENTED = _list("""
Auvergne-Rhône-Alpes; Bourgogne-Franche-Comté; Bretagne; Centre-Val de Loire; Corse; Grand Est; Hauts-de-France
Île-de-France; Normandie; Nouvelle-Aquitaine; Occitanie; Pays de la Loire; Provence-Alpes-Côte d'Azur; Guadeloupe
Martinique; Guyane; La Réunion; Mayotte
""")

FRANCE_PLACES = [
    (place, region)
    for region, places in _pairs("""
Hauts-de-France=nord, pas-de-calais, aisne, somme, oise, lille, tourcoing, dunkerque, calais, roubaix
Nouvelle-Aquitaine=gironde, dordogne, landes, lot-et-garonne, pyrenees-atlantiques, charente, charente-maritime, bordeaux, pessac, merignac, la teste-de-buch, lege-cap-ferret
Pays de la Loire=loire-atlantique, maine-et-loire, mayenne, sarthe, vendee, nantes, saint-nazaire, pornic, la baule-escoublac, saint-herblain
Ile-de-France=paris, seine-et-marne, yvelines, essonne, hauts-de-seine, seine-saint-denis, val-de-marne, val-d-oise
""")
    for place in places.split(", ")
]

#: Places that the bulk profile does not know.
FRANCE_PLACES_NOT_BULK = _list("la teste-de-buch; lege-cap-ferret; la baule-escoublac; saint-herblain")

INDIA_ALIASES_BULK = _pairs("tamilnadu=Tamil Nadu; orissa=Odisha; uttaranchal=Uttarakhand")

LEGAL_WORDS = "corp corporation inc incorporated llc ltd limited pvt private co company gmbh sa sas sarl".split()
STOPWORDS = "the and of in at on for by de la le du des et".split()

HARMONISED = _pairs("laxmi=lakshmi; choudhary|choudhury|chowdhury=chaudhary; bikas=vikas; parsad=prasad")

#: Word groups that leave names, one after another.
DESCRIPTORS = _list("""
private limited|pvt ltd|pvt limited|private ltd|praaivett limittedd|praiveett limittedd|piraiveett limittett|elelpii
limited liability company|limited liability co|llc|pllc|llp; incorporated|corporation|inc|corp
limited|ltd|company|co|public|foundation|trust; sarl|sas|sa|eurl|snc; com|org|net
enterprises|enterprise|industries|industry; solutions|services|service|svc|serv
holdings|holding|group|grp|associates|assoc|brothers|bros|sons|son|partners
ventures|capital|trading|traders|exports|marketing|management|mgmt; products|agency|firm
technologies|technology|tech|techno|systems|system|engineering|engg|infratech|infra
consulting|consultancy|consultants|consultant|advisory|advisors
medicine|medical|clinic|care|health|healthcare|dental|hospital|pediatric|specialists|physicians|pharmaceuticals|pharma
center|centre|business|store|shop|barbershop|salon|bazaar|market|mart; institute|institution|school|academy|society
international|intl|int|global|national|metro|india; sri|shri|smt; the|and|of|in|at|for|to|a|an
""")

#: Words of a name that weigh little in the gated profile.
GENERIC_WORDS = sorted({w for g in DESCRIPTORS for phrase in g.split("|") for w in phrase.split()} - {"praiveett", "piraiveett", "limittett"})

ADDRESS_PACKAGE = _pairs("""
rd=road; st=street; ave|av=avenue; blvd=boulevard; dr=drive; ln=lane; ct=court; pl=place; sq=square; hwy=highway
pkwy=parkway; ste|suite=suite; apt|apartment=apartment; fl|floor=floor; bldg|building=building; dept|department=dept
opp|opposite=opposite; nr=near; ext=extension; dist=district; sec=sector; col=colony; nagar=nagar; marg=marg
""")

ADDRESS_FRANCE = _pairs("""
r=rue; av|ave=avenue; bd|bvd=boulevard; all=allee; ch|che=chemin; rte=route; imp=impasse; pl=place; sq=square
crs=cours; pass=passage; rpt=rond point; zi=zone industrielle; za=zone d activite; zac=zone d amenagement concerte
st=saint; ste=sainte; bat=batiment; res=residence; imm=immeuble; etg=etage; app|apt|appt=appartement
""")

ADDRESS_NOTEBOOK = _pairs("""
st|str=street; rd|marg|rasta=road; ave|av=avenue; blvd=boulevard; hwy=highway; dr=drive; ln=lane; ct=court
pkwy=parkway; n=north; s=south; e=east; w=west; ne=northeast; nw=northwest; se=southeast; sw=southwest; ste=suite
apt|flat=apartment; fl|flr=floor; gr flr|gf=ground floor; bldg=building; plt|plot no=plot; sec|sector no=sector
opp|opp to|opposite to=opposite; nr|near to=near; behind=behind
""")

ADDRESS_BULK = _pairs("st=street; rd=road; ave=avenue; blvd=boulevard; dr=drive; ln=lane; hwy=highway; pkwy=parkway; ste=suite; apt=apartment; fl=floor; bldg=building")
ADDRESS_BULK_FRANCE = _pairs("r=rue; av|ave=avenue; bd|bvd=boulevard; all=allee; ch|che=chemin; rte=route; imp=impasse; pl=place; sq=square; zi=zone industrielle; st=saint; ste=sainte")

STREET_WORDS = "street|st|road|rd|avenue|ave|drive|dr|boulevard|blvd|lane|ln|court|ct|parkway|pkwy|highway|hwy|marg|circle|cir|way"
NUMBER_MARKS = r"(?:#|no\.?|plot\s*(?:no\.?)?|shop\s*(?:no\.?)?|flat\s*(?:no\.?)?)"
URL_TAIL = r"\s*\|\s*(?:www\.|https?://|\S+\.(?:com|org|net|in|co|io))\S*"
URL = r"https?://\S+|www\.\S+"
HANDLE = r"^\s*[@#*]+\s*"
DOMAIN_END = r"\.(com|org|net|in|co|io|biz|info|us|edu|gov)\b"
POSSESSIVE = r"['’]s\b"
#: Texts that a table reader takes for a missing value.
NA_STRINGS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
# ------------------------------------------------------------------------------------------------------------------

FRANCE_PLACES_BULK = [x for x in FRANCE_PLACES if x[0] not in FRANCE_PLACES_NOT_BULK]
US_52 = [n for _, n in US_STATES]
US_CODES = [(c.lower(), n) for c, n in US_STATES]
US_51 = [(c, n) for c, n in US_STATES if c != "PR"]
