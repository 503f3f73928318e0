"""Weights written by pii_train; made, not edited."""

WEIGHTS: dict[str, float] = {
    "email:at": -0.734,
    "email:bias": -0.3,
    "email:dotted": 0.571,
    "email:spelt_at": 2.104,
    "email:tld_alpha": 7.249,
    "email:tld_other": -4.125,
    "email:undotted": -1.59,
    "email>email": 0.943,
    "email>national_id": 1.287,
    "email>person_name": 0.819,
    "email>phone": 1.636,
    "email>street_address": 2.307,
    "national_id:324": -0.093,
    "national_id:444": -0.541,
    "national_id:bias": 0.5,
    "national_id:checked": 3.81,
    "national_id:cue": 0.032,
    "national_id:far_cue": 1.709,
    "national_id:invalid": -4.823,
    "national_id:key": 2.848,
    "national_id:other_key": -1.163,
    "national_id:pan": 2.575,
    "national_id:pan_mixed": -0.888,
    "national_id:pan_other": -0.888,
    "national_id:pan_type": 4.092,
    "national_id:part": -4.895,
    "national_id:unchecked": -5.239,
    "national_id:valid": 5.055,
    "national_id>email": 1.274,
    "national_id>national_id": 1.279,
    "national_id>person_name": 1.126,
    "national_id>phone": 2.534,
    "national_id>street_address": 2.317,
    "person_name:acronym_initial": -3.132,
    "person_name:acronym_run": -3.557,
    "person_name:acronym_turned": -1.039,
    "person_name:ahead_e": -2.97,
    "person_name:ahead_g": -1.387,
    "person_name:ahead_o": -0.456,
    "person_name:ahead_p": -1.226,
    "person_name:ahead_q": -0.493,
    "person_name:ahead_s": -1.96,
    "person_name:ahead_u": -0.67,
    "person_name:ahead_x": -0.299,
    "person_name:ahead_y": -0.766,
    "person_name:before_count": -1.005,
    "person_name:before_number": -2.873,
    "person_name:behind_e": -2.79,
    "person_name:behind_g": -3.225,
    "person_name:behind_low_initial": -2.59,
    "person_name:behind_low_run": 1.153,
    "person_name:behind_low_turned": 1.765,
    "person_name:behind_number": -0.775,
    "person_name:behind_o": 0.457,
    "person_name:behind_p": -1.787,
    "person_name:behind_s": -1.305,
    "person_name:behind_u": -3.223,
    "person_name:behind_x": -0.401,
    "person_name:behind_y": -0.89,
    "person_name:bias": 0.059,
    "person_name:camel": -0.669,
    "person_name:cue": 1.895,
    "person_name:far_cue": 0.408,
    "person_name:hyphen": 1.673,
    "person_name:initial": -0.717,
    "person_name:key": 4.301,
    "person_name:middle_e": -2.5,
    "person_name:middle_g": 2.164,
    "person_name:middle_o": -2.103,
    "person_name:middle_p": -0.1,
    "person_name:middle_q": -0.08,
    "person_name:middle_s": -1.65,
    "person_name:middle_u": 0.062,
    "person_name:middle_x": -0.147,
    "person_name:middle_y": -1.313,
    "person_name:mixed": -3.532,
    "person_name:other_key": 0.706,
    "person_name:pair_ee": 3.1,
    "person_name:pair_eg": 0.699,
    "person_name:pair_eo": -4.54,
    "person_name:pair_ep": -1.084,
    "person_name:pair_es": 3.586,
    "person_name:pair_eu": 0.347,
    "person_name:pair_ey": 1.022,
    "person_name:pair_ge": 4.841,
    "person_name:pair_gg": 2.471,
    "person_name:pair_go": -3.33,
    "person_name:pair_gp": -4.383,
    "person_name:pair_gq": 1.337,
    "person_name:pair_gs": 4.572,
    "person_name:pair_gu": 3.984,
    "person_name:pair_gx": -1.885,
    "person_name:pair_gy": 2.811,
    "person_name:pair_oe": -4.815,
    "person_name:pair_og": -3.22,
    "person_name:pair_oo": -7.274,
    "person_name:pair_op": -4.288,
    "person_name:pair_oq": -1.932,
    "person_name:pair_os": -4.467,
    "person_name:pair_ou": -5.052,
    "person_name:pair_ox": -0.973,
    "person_name:pair_oy": -4.545,
    "person_name:pair_pe": -0.009,
    "person_name:pair_po": -5.777,
    "person_name:pair_pp": -5.686,
    "person_name:pair_pq": -0.918,
    "person_name:pair_ps": -0.633,
    "person_name:pair_pu": -2.389,
    "person_name:pair_px": -2.173,
    "person_name:pair_py": -1.633,
    "person_name:pair_qe": -0.961,
    "person_name:pair_qo": -1.77,
    "person_name:pair_qu": -0.707,
    "person_name:pair_se": 2.997,
    "person_name:pair_sg": 0.065,
    "person_name:pair_so": -2.531,
    "person_name:pair_sp": -0.123,
    "person_name:pair_ss": 3.041,
    "person_name:pair_su": 2.401,
    "person_name:pair_sx": -0.37,
    "person_name:pair_sy": 1.129,
    "person_name:pair_ue": 3.481,
    "person_name:pair_ug": 1.213,
    "person_name:pair_uo": -4.791,
    "person_name:pair_up": -3.365,
    "person_name:pair_uq": -0.356,
    "person_name:pair_us": 3.816,
    "person_name:pair_uu": 0.956,
    "person_name:pair_ux": -2.082,
    "person_name:pair_uy": 0.349,
    "person_name:pair_xe": 0.888,
    "person_name:pair_xo": -3.805,
    "person_name:pair_xp": -2.2,
    "person_name:pair_xu": 0.158,
    "person_name:pair_ye": 1.293,
    "person_name:pair_yg": 0.834,
    "person_name:pair_yo": -4.515,
    "person_name:pair_yq": -0.04,
    "person_name:pair_ys": 1.177,
    "person_name:pair_yu": 0.804,
    "person_name:particle_or_initial": 3.338,
    "person_name:run": 0.193,
    "person_name:single_e": 0.526,
    "person_name:single_g": 1.084,
    "person_name:single_o": -4.666,
    "person_name:single_q": -0.228,
    "person_name:single_s": 2.853,
    "person_name:single_u": 0.419,
    "person_name:single_y": 0.485,
    "person_name:street_word": -3.2,
    "person_name:turned": 2.684,
    "person_name:upper": 0.603,
    "person_name:words1": 1.173,
    "person_name:words2": -0.626,
    "person_name:words3": -0.498,
    "person_name:words4": -0.305,
    "person_name>email": 1.792,
    "person_name>national_id": 0.194,
    "person_name>person_name": -0.554,
    "person_name>phone": 1.535,
    "person_name>street_address": 1.189,
    "phone:22222": 2.793,
    "phone:334": 6.446,
    "phone:344": 1.006,
    "phone:bare": -4.9,
    "phone:bias": -0.089,
    "phone:code_shape": -3.88,
    "phone:cue": 1.926,
    "phone:date": -3.894,
    "phone:far_cue": 1.048,
    "phone:key": 2.859,
    "phone:n10": 1.781,
    "phone:n11": 1.556,
    "phone:n12": -1.395,
    "phone:n13": 0.448,
    "phone:n7": -4.429,
    "phone:n8": -4.116,
    "phone:n9": -3.14,
    "phone:one_group": -5.89,
    "phone:other_key": -0.491,
    "phone:paren": 2.271,
    "phone:part": -5.853,
    "phone:plus": 6.25,
    "phone:tiny_group": -3.743,
    "phone:zero": 0.204,
    "phone:zeros": 2.473,
    "phone>email": 1.301,
    "phone>national_id": 1.919,
    "phone>person_name": 0.833,
    "phone>phone": 0.291,
    "phone>street_address": 2.386,
    "street_address:bias": 2.905,
    "street_address:capital": 2.835,
    "street_address:counted": -2.197,
    "street_address:cue": 4.285,
    "street_address:far_cue": 0.18,
    "street_address:goes_on": -2.276,
    "street_address:goes_on_capital": -0.882,
    "street_address:key": 3.087,
    "street_address:ordinary": -4.996,
    "street_address:other_key": -0.209,
    "street_address:way0": 0.408,
    "street_address:way1": -0.288,
    "street_address:way2": 3.984,
    "street_address:way3": 2.554,
    "street_address:way4": 1.654,
    "street_address:way5": 3.193,
    "street_address>email": 1.588,
    "street_address>national_id": 1.905,
    "street_address>person_name": 1.004,
    "street_address>phone": 1.818,
    "street_address>street_address": 1.07,
}
