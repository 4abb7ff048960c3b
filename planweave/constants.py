"""These must equal the documented drawing rules, so they are stated plainly."""

# Layer words, tested in this order on the lower-cased layer name.
WALL_WORDS = ("wall", "mur", "wand", "cloison")
DOOR_WORDS = ("door", "porte", "tür", "tur")
WINDOW_WORDS = ("window", "fenetre", "fenêtre", "fenster")

# Current rule set (profile "v2"), metres and degrees.
MIN_WALL_LENGTH = 0.1
MIN_PAIR_DISTANCE = 0.01
MAX_PAIR_DISTANCE = 0.8
PARALLEL_TOLERANCE = 5.0
OVERLAP_TOLERANCE = 0.3
DEFAULT_HEIGHT = 3.0
DEFAULT_THICKNESS = 0.2
SINGLE_LINE_CONFIDENCE = 0.8
ANGLE_BUCKET = 5
ANGLE_BUCKETS = 36

# First rule set (profile "v1").
V1_MIN_WALL_LENGTH = 0.3
V1_MAX_PAIR_DISTANCE = 1.0
V1_OVERLAP_TOLERANCE = 0.5

# Joining broken line fragments.
FRAGMENT_OFFSET = 0.015
FRAGMENT_GAP = 0.5

# Drawing span up to which the unit is taken as metres, then inches, else millimetres.
METRE_SPAN = 100.0
INCH_SPAN = 2000.0
INCH = 0.0254
MILLIMETRE = 0.001

# Drawing header unit codes.
UNIT_NAMES = {0: "unitless", 1: "inches", 2: "feet", 4: "mm", 5: "cm", 6: "meters"}

# Pixel lines.
PIXELS_PER_METRE = 100.0
MIN_PIXEL_LENGTH = 20.0

# Accepted file kinds and size.
RASTER_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff")
VECTOR_SUFFIXES = (".dxf",)
PDF_SUFFIXES = (".pdf",)
MAX_FILE_MB = 50

# Box models.
MIN_BOX_LENGTH = 1e-6
MIN_BOX_THICKNESS = 0.05
MODEL_FORMAT = "floorplan-json-v1"

# Room plans.
HALLWAY_WIDTH = 1.2
PUBLIC_ROOMS = ("living", "kitchen", "dining", "office")
PRIVATE_ROOMS = ("bedroom", "bathroom", "storage")
OPEN_ROOMS = ("living", "kitchen", "dining")
WINDOWLESS_ROOMS = ("bathroom", "hallway", "storage")
ROOM_NAMES = {
    "living": "Living Room",
    "kitchen": "Kitchen",
    "dining": "Dining Room",
    "hallway": "Hallway",
    "office": "Office",
    "storage": "Storage",
}
DOOR_WIDTH = 0.9
DOOR_CLEARANCE = 0.5
DOOR_POSITION = 0.3
WINDOW_WIDTH = 1.2
WINDOW_SHARE = 0.4
OUTLINE_INSET = 0.05
ARC_STEPS = 12
EDGE_GRID = 0.01
