"""Rule tables as data. Labels and terms that results depend on, in order of precedence."""

# Anatomy, 'label: terms' by line, first line with a term (as whole tokens) wins.
ANATOMY = """
knee: acl, anterior cruciate ligament, mcl, pcl, meniscus, meniscal, meniscectomy, patellofemoral, femoral condyle, popliteus
achilles: achilles, achillies
posterior tibialis: posterior tibialis
hamstring: hamstring
quadriceps: quadricep, quadriceps, quad
trapezius: trapezius, upper trap
groin: groin, adductor, inguinal, sports hernia
ankle: syndesmosis, ankle, anke
knee: knee, knees, patella, patellar
foot: cuneiform, cuboid, metatarsal, navicular, lisfranc, retrocalcaneal, heel, foot, midfoot, plantar
toe: mtp, mp joint, hallucis, toe, toes
pelvis: pelvis, pelvic, pubic bone, sacrum, sacral, sacroiliac, si, iliac wing, ilium, ischial
sciatic nerve: sciatic nerve, sciatica
hip: hip, glut, glute, gluteal, gluteus
back: back, midback, lumbar, thoracic, thoratic, disc, facet
shoulder: acromioclavicular, ac joint, ac, rotator cuff, shoulder
wrist: ulnar styloid, scapholunate, perilunate, scaphoid, distal radius, flexor carpi ulnaris, wrist
hand: metacarpal, hand
thumb: thumb
finger: finger, fingers, pinkie, pinky
elbow: ucl, olecranon, elbow
calf: calf, soleus, plantaris
lower leg: lower leg, shin, shins, tib, tibia, tibial, fib, fibula, fibular, peroneal
leg: leg
thigh: thigh
neck: neck, cervical, anterior triangle
head: concussion, head
head: migraine, headache
face: zygomatic, orbital, oribital, facial, face, jaw, lip, chin
mouth: dental, tooth, oral, mouth
throat: throat, pharyngitis
forearm: forearm
arm: biceps, arm
respiratory system: lung, respiratory, asthma, bronchitis, pneumothorax, sinus, sinusitis, congestion
rib: ribcage, costochondral, rib, ribs
chest: sternum, chest, pectoral, pectoralis
torso: trunk
whole body: overall body
abdomen: abdomen, abdominal, oblique, core, rectus abdominis, appendectomy
stomach: stomach, g/i, gastrointestinal, gastroenteritis
tailbone: tailbone, tail bone, coccyx
nose: nasal, nose
eye: retina, retinal, corneal, cornea, eye
ear: ear
skin: skin
illness: illness, ilness, illlness, flu, virus, covid, health and safety, infection, mononucleosis, tonsillitis, strep throat, food poisoning, common cold, cold, sick, under the weather
"""

# Conditions, 'label: terms' by line, first line with a term (as a substring) wins.
# recovery and procedure terms are tables of their own.
CONDITION_FIRST = """
concussion: concussion
whiplash: whiplash
pneumothorax: pneumothorax
neuropathy: neuropathy
migraine: migraine
headache: headache
turf toe: turf toe
sciatica: sciatica
asthma: asthma
chondromalacia: chondromalacia
disc injury: disc bulge, disc protrusion, annular fissure
nerve issue: radiculopathy, stinger, neuroma
fracture: fracture, fractuce, broken
tear: rupture, tear, torn
sprain: sprain
strain: strain
"""
CONDITION_THEN = """
stress reaction: stress reaction, stress response, bone stress
hyperextension: hyperextension, hyperextended
subluxation: sublux
dislocation: dislocation, dislocated, displacement
separation: separation
contusion: contusion, contuson, contused, pointer
abrasion: abrasion
laceration: laceration, lacerated, stitches, sutures
bruise: bruise
pain: pain, discomfort, ache
soreness: sore
inflammation: inflammation, imflammation, tendinitis, tendonitis, irritation, synovitis, iritis, periostitis
tendinopathy: tendinopathy, tendonopathy, tendinosis
plantar fasciitis: fasciitis
sesamoiditis: sesamoiditis
capsulitis: capsulitis
bursitis: bursitis
swelling: edema, swelling, swollen, effusion
tightness: tightness, tension
infection: infection, strep throat, tonsillitis, sinusitis, pharyngitis
allergic reaction: allergic&reaction
illness: illness, ilness, illlness, flu, infuenza, virus, covid, health and safety, bronchitis, gastroenteritis, gastrointestinal, g/i symptoms, mononucleosis, food poisoning, cold, sick, under the weather, congestion
injury management: management
impingement: impingement
stiffness: stiffness
spasm: spasm
nerve issue: neuritis, neuropraxia
medical condition: medical condition, medical assessment, condition+respiratory system
blood clot: deep vein thrombosis, blood clot, dvt
hernia: hernia
dehydration: dehydration
dysfunction: dysfunction, dysfucntion
instability: instability
arthritis: arthritis
protective equipment: facemask, face mask
immobilization: splint, brace, cast
lesion: lesion
thoracic outlet syndrome: ; tos
syndrome: syndrome
tendon injury: mallet, tendon
injury management: maintenance
dental procedure: dental work
injury: injury
"""
RECOVERY = ("return to competition", "return to play", "conditioning", "recovery", "rehab")
PROCEDURE = ("surgery", "surgical", "arthroscopy", "scope", "procedure", "repair", "reconstruction", "meniscectomy", "appendectomy", "excision")
LIGAMENTS = {"ACL": ("acl", "anterior cruciate ligament"), "MCL": ("mcl", "medial collateral ligament"), "PCL": ("pcl", "posterior cruciate ligament")}

# Reasons that are no injury, as whole tokens, and categories that are none.
NON_INJURY = ("g league", "rest", "personal", "family reasons", "not with team", "coach's decision", "coach’s decision", "coaches decision", "suspension", "not yet submitted", "all players available", "contract expired", "trade pending", "ineligible to play")
NON_INJURY_CATEGORIES = ("-", "coach's decision", "g league", "g league - on assignment", "g league - two-way", "g league team", "league suspension", "not with team", "not yet submitted", "personal reasons", "rest", "team suspension", "trade pending")

# What a clause that is no injury opens with, as patterns.
NON_INJURY_OPENINGS = (
    r"g[ -]?league(?:\s*[- ]?(?:on assignment|two[ -]?way|2[ -]?way|assignment))?", "rest", "personal(?: reasons?)?", "family reasons?", "not with team",
    "coach(?:es|'s|’s)? decision", "(?:league|team) suspension", "trade pending", "ineligible to play", "contract expired",
)

# Reasons that are a condition as a whole text only, and prefixes of reasons that are categories.
WHOLE_REASONS = {"mask": "protective equipment", "tos": "thoracic outlet syndrome"}
REASON_PREFIXES = ("Injury/Illness", "G League", "League Suspension")
LIGAMENT_TYPES = ("ACL injury", "ACL tear", "MCL injury", "MCL tear", "PCL injury", "PCL tear")

# Notes of transactions, by substring, first line wins; parts of the body, then conditions.
NOTE_PARTS = """
knee: knee
ankle: ankle
foot: foot
hand: hand
wrist: wrist
shoulder: shoulder
elbow: elbow
hip: hip
back: back
hamstring: hamstring
quadriceps: quad
groin: groin
thumb: thumb
finger: finger
toe: toe
neck: neck
head: head
shin: shin
thigh: thigh
abductor: abductor
plantaris: plantaris
leg: leg
arm: arm
chest: chest
rib: rib
abdomen: abdomen, abdominal
eye: eye
nose: nose
mouth: mouth
jaw: jaw
"""
NOTE_CONDITIONS = """
plantar fasciitis: plantar fasci
hyperextension: hyperextend
turf toe: turf toe
stress reaction: stress reaction, stress fracture
subluxation: sublux
impingement: impingement
bursitis: bursitis
infection: infection, infected
tendinopathy: tendinopathy, tendinosis
synovitis: synovitis
blood clot: blood clot
corneal abrasion: corneal abrasion, abrasion+eye
shin splints: shin split
nerve issue: nerve, pinched
disc injury: bulging disc, disc+back
loose bodies: loose&cartilage, loose&bodies
scar tissue: scar tissue
cyst: cyst
concussion: concussion
hernia: hernia
retinal injury: retina
dislocation: dislocate, separated
contusion: contusion, pointer
swelling: swelling, swollen
laceration: laceration, lacerated
tear: torn, tear, ruptured
strain: strain
sprain: sprain
fracture: fracture, broken
surgery: surgery
bruise: bruise
illness: illness, flu, virus, sick, migraine, covid
soreness: sore
stiffness: stiff
inflammation: inflammation, tendinitis, irritation, inflamed
tightness: tightness
spasm: spasm
non-injury: legal, fined, coach
rehab: rehab
rest: rest
"""

# Literals that a CSV reader takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")

# Phases of seasons, 'season phase first last', both days inclusive; where two hold, the first listed of
# playoffs, play_in, regular, preseason.
PHASES = """
2019-20 regular 2019-10-22 2020-08-14
2019-20 play_in 2020-08-15 2020-08-15
2019-20 playoffs 2020-08-17 2020-10-11
2020-21 preseason 2020-12-11 2020-12-19
2020-21 regular 2020-12-22 2021-05-16
2020-21 play_in 2021-05-18 2021-05-21
2020-21 playoffs 2021-05-22 2021-07-20
2021-22 preseason 2021-10-03 2021-10-15
2021-22 regular 2021-10-19 2022-04-10
2021-22 play_in 2022-04-12 2022-04-15
2021-22 playoffs 2022-04-16 2022-06-16
2022-23 preseason 2022-09-30 2022-10-14
2022-23 regular 2022-10-18 2023-04-09
2022-23 play_in 2023-04-11 2023-04-14
2022-23 playoffs 2023-04-15 2023-06-12
2023-24 preseason 2023-10-05 2023-10-20
2023-24 regular 2023-10-24 2024-04-14
2023-24 play_in 2024-04-16 2024-04-19
2023-24 playoffs 2024-04-20 2024-06-17
2024-25 preseason 2024-10-04 2024-10-18
2024-25 regular 2024-10-22 2025-04-13
2024-25 play_in 2025-04-15 2025-04-18
2024-25 playoffs 2025-04-19 2025-06-22
2025-26 preseason 2025-10-02 2025-10-17
2025-26 regular 2025-10-21 2026-04-12
2025-26 play_in 2026-04-14 2026-04-17
2025-26 playoffs 2026-04-18 2026-06-13
2026-27 preseason 2026-10-03 2026-10-16
2026-27 regular 2026-10-20 2027-04-11
2026-27 play_in 2027-04-13 2027-04-16
"""


def lines(table: str) -> list[tuple[str, tuple[str, ...]]]:
    """(label, terms) of a table above."""
    out = []
    for line in table.strip().splitlines():
        label, _, terms = line.partition(": ")
        out.append((label, tuple(t.strip() for t in terms.split(","))))
    return out
