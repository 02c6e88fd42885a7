"""Values that fix the results: input schemas, tags, preprocessing rules and model columns."""

# --- fixed values: input schemas -----------------------------------------------------------

TRANSACTIONS = ["parcelid INT NOT NULL", "logerror FLOAT", "transactiondate DATE"]

PROPERTIES = [
    "parcelid INT NOT NULL", "airconditioningtypeid INT", "architecturalstyletypeid INT", "basementsqft INT",
    "bathroomcnt FLOAT", "bedroomcnt FLOAT", "buildingclasstypeid INT", "buildingqualitytypeid INT",
    "calculatedbathnbr FLOAT", "decktypeid INT", "finishedfloor1squarefeet INT", "calculatedfinishedsquarefeet FLOAT",
    "finishedsquarefeet12 INT", "finishedsquarefeet13 INT", "finishedsquarefeet15 INT", "finishedsquarefeet50 INT",
    "finishedsquarefeet6 INT", "fips INT", "fireplacecnt INT", "fullbathcnt INT", "garagecarcnt INT",
    "garagetotalsqft INT", "hashottuborspa BOOLEAN", "heatingorsystemtypeid INT", "latitude INT", "longitude INT",
    "lotsizesquarefeet FLOAT", "poolcnt INT", "poolsizesum INT", "pooltypeid10 INT", "pooltypeid2 INT",
    "pooltypeid7 INT", "propertycountylandusecode STRING", "propertylandusetypeid INT", "propertyzoningdesc STRING",
    "rawcensustractandblock FLOAT", "regionidcity INT", "regionidcounty INT", "regionidneighborhood INT",
    "regionidzip INT", "roomcnt FLOAT", "storytypeid INT", "threequarterbathnbr INT", "typeconstructiontypeid INT",
    "unitcnt INT", "yardbuildingsqft17 INT", "yardbuildingsqft26 INT", "yearbuilt FLOAT", "numberofstories INT",
    "fireplaceflag BOOLEAN", "structuretaxvaluedollarcnt FLOAT", "taxvaluedollarcnt FLOAT", "assessmentyear INT",
    "landtaxvaluedollarcnt FLOAT", "taxamount FLOAT", "taxdelinquencyflag STRING", "taxdelinquencyyear INT",
    "censustractandblock STRING",
]

EXTERNAL_FEATURES = [
    "parcelid INT NOT NULL", "elevation FLOAT", "amenity INT", "highway INT", "aeroway INT", "railway INT",
    "historic INT", "natural INT", "B00001_001E FLOAT", "B19313_001E FLOAT", "name_close_city STRING",
    "population_close_city FLOAT", "distance_close_city FLOAT", "name_close_big_city STRING",
    "population_close_big_city FLOAT", "distance_close_big_city FLOAT", "bar FLOAT", "restaurant FLOAT",
    "hospital FLOAT", "school FLOAT", "parking FLOAT", "fast_food FLOAT", "aerodrome FLOAT", "station FLOAT",
    "monument FLOAT", "beach FLOAT",
]

# --- fixed values: feature extraction --------------------------------------------------------

HULL_BUFFER_DEGREES = 0.2
POI_RADIUS_METRES = 500
BIG_CITY_POPULATION = 250000
CENSUS_VARIABLES = ["B00001_001E", "B00002_001E", "B19313_001E"]
REDUNDANT_FEATURES = ["B00002_001E", "pub"]
POI_TAGS = {
    "amenity": [
        "bar", "cafe", "pub", "restaurant", "hospital", "clinic", "fire_station", "school", "college",
        "university", "parking", "police", "townhall", "fast_food",
    ],
    "highway": ["motorway", "trunk"],
    "aeroway": ["aerodrome", "helipad"],
    "railway": ["station", "subway_entrance", "tram_stop"],
    "historic": ["castle", "church", "monastery", "monument"],
    "natural": ["beach", "hill"],
}

# --- fixed values: preprocessing rules -------------------------------------------------------

FILL = {
    "poolsizesum": 0, "yardbuildingsqft17": 0, "garagetotalsqft": 0, "garagecarcnt": 0, "lotsizesquarefeet": 0,
    "numberofstories": 0, "poolcnt": 0, "pooltypeid7": 0, "fips": 0, "decktypeid": 0, "fireplacecnt": 0,
    "heatingorsystemtypeid": 0, "propertylandusetypeid": 0, "buildingqualitytypeid": 0, "regionidcounty": 0,
    "regionidneighborhood": 0, "regionidcity": 0, "threequarterbathnbr": 0, "unitcnt": 0, "airconditioningtypeid": 0,
    "assessmentyear": 2015, "taxdelinquencyflag": "N", "propertycountylandusecode": "UNK",
    "propertyzoningdesc": "OTHER", "censustractandblock": "UNK", "name_close_city": "UNK",
    "name_close_big_city": "UNK",
}
LOG = [
    "calculatedfinishedsquarefeet", "yardbuildingsqft17", "taxvaluedollarcnt", "lotsizesquarefeet", "elevation",
    "amenity", "B00001_001E", "B19313_001E", "distance_close_city", "distance_close_big_city",
    "population_close_city", "population_close_big_city",
]
SQRT = ["bar", "restaurant", "school", "aerodrome", "monument"]
CUBE_ROOT = ["fast_food", "parking", "station"]
KEEP = [
    ("decktypeid", [0], 1),
    ("fireplacecnt", [0], 1),
    ("heatingorsystemtypeid", [2, 7, 0], 3),
    ("airconditioningtypeid", [0, 1, 13], 0),
    ("propertylandusetypeid", [261, 266, 246, 269], 0),
    ("propertyzoningdesc", ["LAR1", "LAR3", "LARS", "LBR1N", "LARD1.5", "LAR2", "SCUR2", "LARD2"], "OTHER"),
    ("propertycountylandusecode", ["0100", "122", "010C", "0101", "34", "1111", "1", "010E", "010D", "0200"], "OTHER"),
]
ABOVE = [
    ("distance_close_city", -2), ("distance_close_big_city", -3), ("highway", 0), ("aeroway", 0), ("railway", 0),
    ("historic", 0), ("natural", 0),
]
DROP = [
    "finishedsquarefeet13", "finishedsquarefeet6", "finishedsquarefeet15", "finishedfloor1squarefeet",
    "yardbuildingsqft26", "basementsqft", "landtaxvaluedollarcnt", "structuretaxvaluedollarcnt",
    "buildingclasstypeid", "fullbathcnt", "architecturalstyletypeid", "storytypeid", "finishedsquarefeet50",
    "finishedsquarefeet12", "taxamount", "parcelid", "pooltypeid10", "pooltypeid2", "taxdelinquencyyear",
    "typeconstructiontypeid", "regionidzip", "fireplaceflag", "hashottuborspa", "transactiondate",
]

# --- fixed values: model columns -------------------------------------------------------------

LABEL = "logerror"
PREDICTION = "prediction"
GROUP = "garagecarcnt"
GROUP_IMPUTED = "garagetotalsqft"
MEAN_IMPUTED = [
    "bathroomcnt", "bedroomcnt", "calculatedbathnbr", "calculatedfinishedsquarefeet", "latitude", "aerodrome",
    "longitude", "rawcensustractandblock", "roomcnt", "yearbuilt", "taxvaluedollarcnt", "elevation", "B00001_001E",
    "B19313_001E", "population_close_city", "population_close_big_city", "bar", "restaurant", "hospital", "school",
    "parking", "fast_food", "station", "monument", "beach",
]
INDEXED = [
    "propertycountylandusecode", "propertyzoningdesc", "censustractandblock", "name_close_city", "name_close_big_city",
]
ONE_HOT = [
    "airconditioningtypeid", "fips", "heatingorsystemtypeid", "propertycountylandusecode_indexed",
    "name_close_big_city_indexed", "propertyzoningdesc_indexed", "regionidcounty",
]
HASHED = [
    "censustractandblock_indexed", "rawcensustractandblock", "regionidneighborhood", "regionidcity",
    "name_close_city_indexed",
]
HASH_OUTPUT = "x_hash"
FEATURES = "x_assembler"
TRAIN_RATIO = 0.75
FOLDS = 3
SEED = 42
SEARCH_ITERATIONS = 1000
SEARCH_SPACE = {
    "maxDepth": [5, 10, 15, 20, 25, 30],
    "maxIter": [16, 32, 64, 128, 256],
    "regLambda": [float(f"{10 ** (-6 + k / 4):.8e}") for k in range(40)],
    "stepSize": [0.001, 0.002, 0.004, 0.008, 0.01, 0.02, 0.04, 0.08, 0.1],
    "minSplitLoss": [0, 1e-3, 5e-3, 1e-2],
    "featureFraction": [1.0, 0.75, 0.5, 0.25, 0.1],
    "maxLeaves": [100, 200, 400, 800, 1000, 2000, 4000, 10000],
    "subsamplingRate": [1.0, 0.9, 0.8, 0.7],
    "numFeatures": [32, 64, 128, 256],
}
