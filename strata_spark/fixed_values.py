"""Fixed values.

Numbers, labels and orders that results depend on; everything else is a
parameter. Nothing in this file is computed.
"""

# Age breaks of the two age schemes.
AGE_BREAKS = (0, 6, 12, 18, 25, 35, 50, 65, 75, 105)
AGE_BREAKS_10Y = (0, 10, 20, 30, 40, 50, 60, 70, 80, 105)

# Factor levels in report order and their reference levels.
SEX_LEVELS = ("Female", "Male")
SEX_CODES = ("f", "m")
INFECTION_LEVELS = ("uninfected", "inf_bef_2022", "inf_2022")
VACCINATION_LEVELS = ("No vacc", "Dose 1 or 2 only", "Boosted")
SERO_AGE_REF = "[25,35)"
PANEL_AGE_REF = "[35,50)"
PANEL_AGE_10Y_REF = "[20,30)"
SEX_REF = "Female"
SEX_CODE_REF = "f"
INFECTION_REF = "uninfected"
VACCINATION_REF = "Dose 1 or 2 only"

# Thresholds.
EC50_THRESHOLD = 50.0
CHILD_AGE = 12

# Population and vaccination counts by age.
# (age_cat_UEP, vacc_status_3way, pop_total, strata_total, percentage)
VACCINATION_BY_AGE = (
    ("[0,6)", "Boosted", 31849.8, 0.0, 0.0),
    ("[6,12)", "Boosted", 32144.57143, 0.0, 0.0),
    ("[12,18)", "Boosted", 31902.0, 1955.4, 6.129396276),
    ("[18,25)", "Boosted", 43021.0, 9283.9, 21.57992608),
    ("[25,35)", "Boosted", 70489.5, 20486.5, 29.06319381),
    ("[35,50)", "Boosted", 114727.5, 42982.0, 37.46442658),
    ("[50,65)", "Boosted", 96005.0, 51167.0, 53.29618249),
    ("[65,75)", "Boosted", 42196.5, 28753.5, 68.1419075),
    ("[75,105]", "Boosted", 44096.5, 33756.5, 76.55142698),
    ("all", "Boosted", 506343.0, 190620.0, 37.64641755),
    ("[0,6)", "Dose 1 or 2 only", 31849.8, 682.8, 2.14381252),
    ("[6,12)", "Dose 1 or 2 only", 32144.57143, 1563.428571, 4.863740601),
    ("[12,18)", "Dose 1 or 2 only", 31902.0, 14356.8, 45.00282114),
    ("[18,25)", "Dose 1 or 2 only", 43021.0, 20166.3, 46.87547942),
    ("[25,35)", "Dose 1 or 2 only", 70489.5, 32796.0, 46.52607835),
    ("[35,50)", "Dose 1 or 2 only", 114727.5, 49392.5, 43.05201456),
    ("[50,65)", "Dose 1 or 2 only", 96005.0, 31268.5, 32.56965783),
    ("[65,75)", "Dose 1 or 2 only", 42196.5, 8864.0, 21.00648158),
    ("[75,105]", "Dose 1 or 2 only", 44096.5, 7618.5, 17.27688139),
    ("all", "Dose 1 or 2 only", 506343.0, 169307.0, 33.43721548),
    ("[0,6)", "No vacc", 31849.8, 31167.0, 97.85618748),
    ("[6,12)", "No vacc", 32144.57143, 30581.14286, 95.1362594),
    ("[12,18)", "No vacc", 31902.0, 15589.8, 48.86778258),
    ("[18,25)", "No vacc", 43021.0, 13570.8, 31.5445945),
    ("[25,35)", "No vacc", 70489.5, 17207.0, 24.41072784),
    ("[35,50)", "No vacc", 114727.5, 22353.0, 19.48355887),
    ("[50,65)", "No vacc", 96005.0, 13569.5, 14.13415968),
    ("[65,75)", "No vacc", 42196.5, 4579.0, 10.85161092),
    ("[75,105]", "No vacc", 44096.5, 2721.5, 6.171691631),
    ("all", "No vacc", 506343.0, 146416.0, 28.91636697),
)

# Vaccination coverage by age, the same for both sexes.
COVERAGE_BY_AGE = (
    ("[0,6)", 0.0217), ("[6,12)", 0.0486), ("[12,18)", 0.5113),
    ("[18,25)", 0.6845), ("[25,35)", 0.7559), ("[35,50)", 0.8052),
    ("[50,65)", 0.8587), ("[65,75)", 0.8915), ("[75,105]", 0.9383),
)

# Vaccination coverage in percent for report categories.
COVERAGE_PERCENT = (
    ("[0,6)", 2.17), ("[6,12)", 4.86), ("[12,18)", 51.13),
    ("[18,25)", 68.45), ("[25,35)", 75.59), ("[35,50)", 80.52),
    ("[50,65)", 85.87), ("[65,75)", 89.15), ("[75,105]", 93.83),
    ("Male", 69.6), ("Female", 72.48), ("All", 71.08),
)

# Assay validation studies.
# (assay, study, positive controls, true positives, negative controls, false positives)
ASSAY_CONTROLS = (
    ("S", 1, 172, 159, 185, 1),
    ("S", 2, 1423, 1406, 5991, 1),
    ("N", 1, 172, 151, 185, 0),
    ("N", 2, 561, 543, 976, 2),
    ("neutralization", 1, 122, 118, 84, 0),
)

# Prior probability that an undated infection is from before
# 2022, by age. The flat value is the default.
OTHER_INFECTION_PRIOR_FLAT = 0.45
OTHER_INFECTION_PRIOR = (
    ("[0,6)", 0.417), ("[6,12)", 0.478), ("[12,18)", 0.549),
    ("[18,25)", 0.598), ("[25,35)", 0.523), ("[35,50)", 0.546),
    ("[50,65)", 0.553), ("[65,75)", 0.528), ("[75,105]", 0.482),
)

# Variant slugs in chronological order with display names.
VARIANT_LABELS = (
    ("any", "any"), ("d614g", "D614G"), ("alpha", "Alpha"), ("beta", "Beta"),
    ("gamma", "Gamma"), ("delta", "Delta"), ("iota", "Iota"),
    ("kappa", "Kappa"), ("lambda", "Lambda"),
    ("omicron_ba_1", "Omicron BA.1"), ("omicron_ba_2", "Omicron BA.2"),
    ("omicron_ba_2_12_1", "Omicron BA.2.12.1"),
    ("omicron_ba_4-ba_5", "Omicron BA.4/BA.5"),
)
VARIANTS_OF_INTEREST = (
    "any", "d614g", "alpha", "delta", "omicron_ba_1", "omicron_ba_2",
    "omicron_ba_2_12_1", "omicron_ba_4-ba_5",
)

# Report names of covariates.
VARIABLE_LABELS = (
    ("all", "All"), ("sex", "Sex"), ("age_cat", "Age"),
    ("inf_latest", "Infection"), ("vacc_status_3way", "Vaccination"),
    ("inf_latest:vacc_status_3way", "Infection/Vaccination"),
)

# Report labels of covariate levels, in report order.
LEVEL_LABELS = (
    ("all", "all"), ("f", "women"), ("m", "men"),
    ("[0,6)", "0-5"), ("[6,12)", "6-11"), ("[12,18)", "12-17"),
    ("[18,25)", "18-24"), ("[25,35)", "25-34"), ("[35,50)", "35-49"),
    ("[50,65)", "50-64"), ("[65,75)", "65-74"), ("[75,105]", "75+"),
    ("uninfected", "uninfected"),
    ("inf_bef_2022", "latest infection\nbefore 2022"),
    ("inf_2022", "latest infection\nin 2022"),
    ("Novacc", "unvaccinated"),
    ("Dose1or2only", "no booster dose"),
    ("Boosted", "booster dose"),
    ("uninfected:Novacc", "unvaccinated\nuninfected"),
    ("inf_bef_2022:Novacc", "unvaccinated\nlatest infection before 2022"),
    ("inf_2022:Novacc", "unvaccinated\nlatest infection in 2022"),
    ("uninfected:Dose1or2only", "vaccinated no booster\nuninfected"),
    ("inf_bef_2022:Dose1or2only", "vaccinated no booster\nlatest infection before 2022"),
    ("inf_2022:Dose1or2only", "vaccinated no booster\nlatest infection in 2022"),
    ("uninfected:Boosted", "vaccinated and booster\nuninfected"),
    ("inf_bef_2022:Boosted", "vaccinated and booster\nlatest infection before 2022"),
    ("inf_2022:Boosted", "vaccinated and booster\nlatest infection in 2022"),
)

# Models from simplest to most complex.
MODEL_COMPLEXITY = (
    "thresh-additive", "thresh-interaction",
    "thresh_od-additive", "thresh_od-interaction",
)

# Patterns in result names.
RESULT_MODEL_PATTERN = "additive|interaction"
RESULT_OUTCOME_PATTERN = "thresh_od|thresh|reg"
RESULT_AGE_PATTERN = "age_cat_uep|age_cat_10y"

# Regression priors of the threshold model.
PRIOR_SD = 1.0
ACCURACY_LOWER = 0.5

#: Rational approximation of the standard normal quantile (Wichura's algorithm AS 241, double precision): for the middle,
#: the tails and the far tails, coefficients of numerator and denominator by rising power.
NORMAL_QUANTILE = (
    ((3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
      4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
     (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
      2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)),
    ((1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
      1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
     (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
      1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)),
    ((6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
      2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
     (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
      7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)))
