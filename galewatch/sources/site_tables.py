"""Public facts about the radar network: display names and time zones."""

from __future__ import annotations

# Display name of each site.
SITE_NAMES = {
    "KABR": "Aberdeen, SD",
    "KABX": "Albuquerque, NM",
    "KAKQ": "Wakefield, VA",
    "KAMA": "Amarillo, TX",
    "KAMX": "Miami, FL",
    "KAPX": "Gaylord, MI",
    "KARX": "La Crosse, WI",
    "KATX": "Seattle, WA",
    "KBBX": "Beale AFB, CA",
    "KBGM": "Binghamton, NY",
    "KBHX": "Eureka, CA",
    "KBIS": "Bismarck, ND",
    "KBLX": "Billings, MT",
    "KBMX": "Birmingham, AL",
    "KBOX": "Boston, MA",
    "KBRO": "Brownsville, TX",
    "KBUF": "Buffalo, NY",
    "KBYX": "Key West, FL",
    "KCAE": "Columbia, SC",
    "KCBW": "Caribou, ME",
    "KCBX": "Boise, ID",
    "KCCX": "State College, PA",
    "KCLE": "Cleveland, OH",
    "KCLX": "Charleston, SC",
    "KCRI": "Norman, OK",
    "KCRP": "Corpus Christi, TX",
    "KCXX": "Burlington, VT",
    "KCYS": "Cheyenne, WY",
    "KDAX": "Sacramento, CA",
    "KDDC": "Dodge City, KS",
    "KDFX": "Laughlin AFB, TX",
    "KDGX": "Jackson, MS",
    "KDIX": "Philadelphia, PA",
    "KDLH": "Duluth, MN",
    "KDMX": "Des Moines, IA",
    "KDOX": "Dover AFB, DE",
    "KDTX": "Detroit, MI",
    "KDVN": "Quad Cities/Davenport, IA",
    "KDYX": "Dyess AFB, TX",
    "KEAX": "Kansas City, MO",
    "KEMX": "Tucson, AZ",
    "KENX": "Albany, NY",
    "KEOX": "Ft Rucker, AL",
    "KEPZ": "El Paso, TX",
    "KESX": "Las Vegas, NV",
    "KEVX": "Northwest Florida/Eglin AFB, FL",
    "KEWX": "San Antonio, TX",
    "KEYX": "Edwards AFB, CA",
    "KFCX": "Blacksburg, VA",
    "KFDR": "Frederick/Altus AFB, OK",
    "KFDX": "Cannon AFB, NM",
    "KFFC": "Atlanta, GA",
    "KFSD": "Sioux Falls, SD",
    "KFSX": "Flagstaff, AZ",
    "KFTG": "Denver, CO",
    "KFWS": "Ft Worth, TX",
    "KGGW": "Glasgow, MT",
    "KGJX": "Grand Junction, CO",
    "KGLD": "Goodland, KS",
    "KGRB": "Green Bay, WI",
    "KGRK": "Central Texas/Ft Hood, TX",
    "KGRR": "Grand Rapids, MI",
    "KGSP": "Greer, SC",
    "KGWX": "Columbus AFB, MS",
    "KGYX": "Portland, ME",
    "KHDC": "Hammond/New Orleans, LA",
    "KHDX": "Holloman AFB, NM",
    "KHGX": "Houston, TX",
    "KHNX": "San Joaquin Valley, CA",
    "KHPX": "Ft Campbell, KY",
    "KHTX": "Huntsville/Hytop, AL",
    "KICT": "Wichita, KS",
    "KICX": "Cedar City, UT",
    "KILN": "Cincinnati/Wilmington, OH",
    "KILX": "Lincoln, IL",
    "KIND": "Indianapolis, IN",
    "KINX": "Tulsa, OK",
    "KIWA": "Phoenix, AZ",
    "KIWX": "Northern Indiana/North Webster, IN",
    "KJAX": "Jacksonville, FL",
    "KJGX": "Robins AFB, GA",
    "KJKL": "Jackson, KY",
    "KLBB": "Lubbock, TX",
    "KLCH": "Lake Charles, LA",
    "KLGX": "Langley Hill, WA",
    "KLIX": "New Orleans, LA",
    "KLNX": "North Platte, NE",
    "KLOT": "Chicago, IL",
    "KLRX": "Elko, NV",
    "KLSX": "St Louis, MO",
    "KLTX": "Wilmington, NC",
    "KLVX": "Louisville, KY",
    "KLWX": "Sterling, VA",
    "KLZK": "Little Rock, AR",
    "KMAF": "Midland/Odessa, TX",
    "KMAX": "Medford, OR",
    "KMBX": "Minot AFB, ND",
    "KMHX": "Morehead City, NC",
    "KMKX": "Milwaukee, WI",
    "KMLB": "Melbourne, FL",
    "KMOB": "Mobile, AL",
    "KMPX": "Minneapolis, MN",
    "KMQT": "Marquette, MI",
    "KMRX": "Knoxville/Morristown, TN",
    "KMSX": "Missoula, MT",
    "KMTX": "Salt Lake City, UT",
    "KMUX": "San Francisco, CA",
    "KMVX": "Grand Forks, ND",
    "KMXX": "Maxwell AFB, AL",
    "KNKX": "San Diego, CA",
    "KNQA": "Memphis, TN",
    "KOAX": "Omaha, NE",
    "KOHX": "Nashville, TN",
    "KOKX": "New York City/Upton, NY",
    "KOTX": "Spokane, WA",
    "KPAH": "Paducah, KY",
    "KPBZ": "Pittsburgh, PA",
    "KPDT": "Pendleton, OR",
    "KPOE": "Ft Polk, LA",
    "KPUX": "Pueblo, CO",
    "KRAX": "Raleigh/Durham, NC",
    "KRGX": "Reno, NV",
    "KRIW": "Riverton, WY",
    "KRLX": "Charleston, WV",
    "KRTX": "Portland, OR",
    "KSFX": "Pocatello, ID",
    "KSGF": "Springfield, MO",
    "KSHV": "Shreveport, LA",
    "KSJT": "San Angelo, TX",
    "KSOX": "Santa Ana Mountains, CA",
    "KSRX": "Fort Smith, AR",
    "KTBW": "Tampa Bay, FL",
    "KTFX": "Great Falls, MT",
    "KTLH": "Tallahassee, FL",
    "KTLX": "Oklahoma City, OK",
    "KTWX": "Topeka, KS",
    "KTYX": "Montague/Ft Drum, NY",
    "KUDX": "Rapid City, SD",
    "KUEX": "Hastings, NE",
    "KVAX": "Moody AFB, GA",
    "KVBX": "Vandenberg AFB, CA",
    "KVNX": "Vance AFB, OK",
    "KVTX": "Los Angeles, CA",
    "KVWX": "Evansville, IN",
    "KYUX": "Yuma, AZ",
    "LPLA": "Lajes Field, Azores",
    "PABC": "Bethel, AK",
    "PACG": "Biorka Island/Sitka, AK",
    "PAEC": "Nome, AK",
    "PAHG": "Anchorage/Kenai, AK",
    "PAIH": "Middleton Island, AK",
    "PAKC": "King Salmon, AK",
    "PAPD": "Fairbanks/Pedro Dome, AK",
    "PGUA": "Andersen AFB, Guam",
    "PHKI": "South Kauai, HI",
    "PHKM": "Kamuela/Kohala, HI",
    "PHMO": "Molokai, HI",
    "PHWA": "South Shore, HI",
    "RKJK": "Kunsan, South Korea",
    "RKSG": "Camp Humphreys, South Korea",
    "RODN": "Kadena, Japan",
    "TJUA": "San Juan, PR",
}

# Time zone of each state, and of the sites that differ from theirs or have none.
STATE_TIMEZONES = {
    "AL": "America/Chicago",
    "AR": "America/Chicago",
    "AZ": "America/Phoenix",
    "CA": "America/Los_Angeles",
    "CO": "America/Denver",
    "CT": "America/New_York",
    "DE": "America/New_York",
    "FL": "America/New_York",
    "GA": "America/New_York",
    "HI": "Pacific/Honolulu",
    "IA": "America/Chicago",
    "ID": "America/Denver",
    "IL": "America/Chicago",
    "IN": "America/Indiana/Indianapolis",
    "KS": "America/Chicago",
    "KY": "America/New_York",
    "LA": "America/Chicago",
    "MA": "America/New_York",
    "MD": "America/New_York",
    "ME": "America/New_York",
    "MI": "America/Detroit",
    "MN": "America/Chicago",
    "MO": "America/Chicago",
    "MS": "America/Chicago",
    "MT": "America/Denver",
    "NC": "America/New_York",
    "ND": "America/Chicago",
    "NE": "America/Chicago",
    "NM": "America/Denver",
    "NV": "America/Los_Angeles",
    "NY": "America/New_York",
    "OH": "America/New_York",
    "OK": "America/Chicago",
    "OR": "America/Los_Angeles",
    "PA": "America/New_York",
    "PR": "America/Puerto_Rico",
    "SC": "America/New_York",
    "SD": "America/Chicago",
    "TN": "America/Chicago",
    "TX": "America/Chicago",
    "UT": "America/Denver",
    "VA": "America/New_York",
    "VT": "America/New_York",
    "WA": "America/Los_Angeles",
    "WI": "America/Chicago",
    "WV": "America/New_York",
    "WY": "America/Denver",
}

SITE_TIMEZONES = {
    "PABC": "America/Anchorage",
    "PACG": "America/Sitka",
    "PAEC": "America/Nome",
    "PAHG": "America/Anchorage",
    "PAIH": "America/Anchorage",
    "PAKC": "America/Anchorage",
    "PAPD": "America/Anchorage",
    "PGUA": "Pacific/Guam",
    "PHKI": "Pacific/Honolulu",
    "PHKM": "Pacific/Honolulu",
    "PHMO": "Pacific/Honolulu",
    "PHWA": "Pacific/Honolulu",
    "RKJK": "Asia/Seoul",
    "RKSG": "Asia/Seoul",
    "RODN": "Asia/Tokyo",
    "LPLA": "Atlantic/Azores",
    "KEPZ": "America/Denver",
    "KFSX": "America/Phoenix",
    "KEVX": "America/Chicago",
    "KHPX": "America/Chicago",
    "KMRX": "America/New_York",
    "KUDX": "America/Denver",
    "KCBX": "America/Boise",
}

# Coordinates that were checked by hand, used where no site table is given.
CORE_SITES = [
    ("KLWX", 38.9753, -77.4778, 327, "Sterling, VA"),
    ("KTLX", 35.3331, -97.2778, 1213, "Oklahoma City, OK"),
    ("KTWX", 38.99695, -96.23255, 1415, "Topeka, KS"),
    ("KILX", 40.1506, -89.3368, 754, "Lincoln, IL"),
    ("KDOX", 38.8257, -75.4401, 50, "Dover, DE"),
    ("KMPX", 44.8488, -93.5654, 946, "Minneapolis, MN"),
    ("KJAX", 30.4847, -81.7019, 33, "Jacksonville, FL"),
    ("KMXX", 32.5366, -85.7897, 460, "Maxwell AFB, AL"),
    ("KMAF", 31.943461, -102.18925, 2961, "Midland/Odessa, TX"),
]
