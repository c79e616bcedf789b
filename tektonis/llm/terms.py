"""Remarks in typed values, and a thesaurus of the building trade.

The thesaurus is an input of the queries over the project's tables, no part of the operator, which has none unless one is given."""

from __future__ import annotations

# Remarks that say nothing about what is meant (patterns over folded text).
FILLERS = (
    r"existing floor is", r"existing\s*:?", r"floor\s*:", r"see plan", r"no access below", r"presumably", r"probably", r"assumed", r"as built", r"as found", r"approx",
    r"ca", r"vermutlich", r"wohl", r"bestand", r"siehe plan", r"type(?=\s*:)", r"with(?:\s+insulation)?(?=\s*$)",
)

# Words that do not speak against a name that lacks them.
WEAK = frozenset("layer layers schicht lage material materials the a of and mit und with".split())

# Usual synonyms in English and German by (kind, local name).
SYNONYMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("function", "AirSpace"): ("air gap", "cavity, unventilated", "cavity", "Luftspalt", "Luftraum", "Hohlraum", "air cavity", "air layer"),
    ("function", "OuterCladding"): ("façade skin", "Verkleidung außen", "external cladding", "Fassadenbekleidung", "Außenverkleidung", "outer skin", "weatherboarding"),
    ("function", "SurfaceFinish"): ("decorative coating", "Deckschicht", "top coat", "Oberflächenfinish", "final coat"),
    ("function", "GlazedInfill"): ("Fensterscheiben", "window panes", "glass panes", "glazing", "Verglasung", "glass infill"),
    ("function", "ThermalInsulation"): ("heat protection", "Wärmeschutz", "lagging", "heat insulation", "Isolierung", "insulation", "Dämmung"),
    ("function", "LoadCarrying"): ("bearing structure", "Tragschicht", "load bearing", "Tragwerk", "structural", "Tragkonstruktion"),
    ("function", "PartitionInfill"): ("filling of a dividing wall", "Wandfüllung", "dividing wall filling", "non-load-bearing infill", "Ausfachung"),
    ("function", "VapourBarrier"): ("Dampfbremse", "vapor retarder", "vapour retarder", "vapor barrier", "moisture barrier", "vapour check", "moisture retarder", "damp proof foil"),
    ("function", "SoundDamping"): ("acoustic layer", "Schallschutz", "sound insulation", "Trittschalldämmung", "noise reduction", "acoustic insulation"),
    ("function", "FireShield"): ("flame protection", "Brandschutz", "fire protection", "Feuerschutz", "fireproofing"),
    ("function", "WaterSealing"): ("waterproofing", "tanking", "damp-proofing", "Bauwerksabdichtung", "Feuchteschutz", "water barrier"),
    ("function", "WindTightening"): ("draught proofing", "Winddichtung", "wind barrier", "windproofing", "airtightness layer"),
    ("function", "LevellingScreed"): ("Estrich", "self-levelling compound", "Nivellierestrich", "floor topping", "floor smoothing mortar", "levelling compound"),
    ("function", "BondingCoat"): ("primer", "adhesion layer", "Grundierung", "Haftgrund", "adhesive coat"),
    ("function", "DrainageMat"): ("seepage layer", "Drainageschicht", "Dränmatte", "drain layer", "Drainmatte"),
    ("function", "RootProtection"): ("root barrier", "Wurzelsperre", "Durchwurzelungsschutz", "anti-root layer"),
    ("category", "CementBound"): ("concrete", "Beton", "cementitious"),
    ("category", "FiredClay"): ("terracotta", "Ziegel", "brick", "burnt clay", "burnt brick", "Backstein", "ceramic", "Klinker"),
    ("category", "SolidWood"): ("lumber", "massive timber", "Massivholz", "solid timber", "timber", "Schnittholz"),
    ("category", "WoodPanel"): ("OSB", "Spanplatte", "plywood", "chipboard", "Sperrholz", "particle board"),
    ("category", "MineralWool"): ("rock wool", "Steinwolle", "glass wool", "Glaswolle", "stone wool"),
    ("category", "PlasticFoam"): ("polyurethane foam", "Styropor", "EPS", "XPS", "polystyrene", "Hartschaum", "rigid foam"),
    ("category", "NaturalFibre"): ("hemp", "Hanf", "flax", "Flachs", "coir", "jute", "plant fibre"),
    ("category", "QuarriedStone"): ("granite", "Naturstein", "natural stone", "sandstone", "Sandstein", "limestone"),
    ("category", "SheetGlass"): ("window glass", "float glazing", "Fensterglas", "float glass", "Floatglas", "glazing"),
    ("category", "FerrousMetal"): ("steel", "Stahl", "iron", "Eisen", "cast iron"),
    ("category", "LightMetal"): ("aluminium", "Alu", "aluminum", "magnesium"),
    ("category", "GypsumProduct"): ("drywall", "plaster sheet", "Gips", "plasterboard", "Gipskarton", "Rigips"),
    ("category", "LimeMortar"): ("lime plaster", "Kalkputz", "lime render"),
    ("category", "BituminousSheet"): ("roofing felt", "Dachpappe", "tar paper", "tar felt", "bitumen membrane", "Teerpappe"),
    ("category", "LooseFill"): ("Kiesbett", "gravel bed", "gravel fill", "Kies", "gravel", "Splitt", "sand filling"),
    ("category", "EarthenMix"): ("rammed loam", "Stampflehm", "adobe", "Lehm", "cob", "rammed earth"),
    ("category", "FoamedGlass"): ("cellular glass", "Glasschaum", "glass foam", "foam glass"),
    ("category", "SlagBlock"): ("Hüttenstein", "cinder block", "clinker block", "blast furnace block"),
    ("category", "RubberLayer"): ("elastomer ply", "EPDM", "Kautschukbahn", "elastomer", "Gummimatte"),
    ("category", "PaperCore"): ("honeycomb cardboard", "Pappwabe", "Wabenkern", "cardboard core", "honeycomb core"),
    ("category", "ReedBoard"): ("Schilfrohrmatte", "reed mat", "reed panel", "Schilfmatte"),
    ("category", "AshBrick"): ("Ascheziegel", "Ascheziegelstein"),
    ("construction", "RibbedConcreteFloor"): ("RC ribbed slab", "reinforced concrete rib deck", "Rippendecke", "concrete rib slab"),
    ("construction", "TimberJoistFloor"): ("wooden beam ceiling", "Holzbalkendecke", "timber beam floor", "wood joist floor", "wooden joist floor"),
    ("construction", "HollowPotFloor"): ("hollow block ceiling", "Hohlkörperdecke", "Hohlsteindecke", "hollow clay pot floor"),
    ("construction", "BrickVault"): ("arched masonry ceiling", "Kappendecke", "brick arch ceiling", "Gewölbedecke", "vaulted brick ceiling"),
    ("construction", "SteelGirderFloor"): ("I-beam ceiling", "steel beam floor", "Stahlbalkendecke", "steel joist ceiling"),
    ("construction", "ScreededGroundSlab"): ("Sohlplatte mit Estrich", "ground-bearing slab with screed", "Kellersohle"),
    ("construction", "PrecastPlankFloor"): ("prefabricated slab", "Elementdecke", "Plattendecke", "prefab plank floor"),
    ("construction", "GluedBoardFloor"): ("Dübelholzdecke", "laminated board floor", "laminated timber deck", "stacked plank ceiling", "Brettschichtholzdecke"),
    ("construction", "PumiceBlockFloor"): ("Bimsdecke", "pumice plank floor"),
    ("construction", "CinderFilledFloor"): ("slag-filled ceiling", "floor with slag filling", "ash-filled floor"),
    ("construction", "StoneFlagFloor"): ("natural stone paving", "flagstone floor", "Natursteinboden"),
    ("construction", "ClayFilledFloor"): ("loam-filled ceiling", "Lehmdecke", "wattle and daub ceiling"),
    ("construction", "CompositeSheetFloor"): ("composite deck", "Stahlverbunddecke", "steel deck with concrete", "profiled sheet floor"),
    ("construction", "SuspendedCellarCeiling"): ("hung basement ceiling", "abgehängte Decke im Keller", "dropped cellar ceiling"),
    ("construction", "CofferedCeiling"): ("waffle slab", "Waffeldecke"),
    ("construction", "MushroomColumnSlab"): ("flat slab on flared columns", "Pilzkopfdecke"),
}
