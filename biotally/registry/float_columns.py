"""Double columns of the registered queries; written by tools/float_columns.py."""

FLOAT_COLUMNS = {'adjacent_naturalness': ('naturalness',),
 'admet_panel': ('oral',
                 'bbb',
                 'caco2',
                 'ppb',
                 'vd',
                 'hepatic',
                 'renal',
                 'log_s',
                 'herg',
                 'ames',
                 'hepatotox',
                 'skin',
                 'cyp_substrate',
                 'cyp_inhibitor',
                 'bioaccumulation',
                 'drug_likeness'),
 'admet_report': ('drug_likeness',),
 'admet_response_defaults': ('confidence', 'likeness'),
 'alignment_stats': ('identity', 'similarity'),
 'all_wells': ('low', 'high'),
 'antigenicity': ('antigenicity',),
 'assemble_construct': ('naturalness', 'kda'),
 'best_hairpin': ('hairpin',),
 'best_self_dimer': ('dimer',),
 'cai': ('cai',),
 'check_lipinski': ('tpsa',),
 'clamp_and_round': ('clamped', 'two_digits'),
 'classify_wells': ('sensitivity', 'specificity'),
 'clock_rate_join': ('rate',),
 'cluster_tree_neighbor_joining': ('max_depth',),
 'cluster_tree_upgma': ('max_depth',),
 'codon_adapt': ('gc_before', 'gc_after', 'cai'),
 'codon_usage': ('fraction',),
 'combined_binding': ('anchor', 'similarity', 'combined', 'rank_proxy', 'confidence'),
 'composite_score': ('hydro_n', 'flex_n', 'surf_n', 'turn_n', 'mean_composite', 'max_composite'),
 'confidence_summary': ('mean_plddt',),
 'design_primers': ('tm_difference', 'cross_dimer'),
 'divergence_time': ('years', 'upper', 'lower'),
 'dose_join': ('course_mg',),
 'dose_rates': ('dose_mg_kg',),
 'dose_report': ('dose_mg', 'daily_mg', 'course_mg', 'volume_ml', 'cost'),
 'dose_superposition_iv': ('t', 'conc'),
 'dose_superposition_oral': ('t', 'conc'),
 'emax_curve': ('top', 'mean_effect', 'first_effect'),
 'exposure_report': ('cmax', 'tmax', 'clast', 'auc', 'mic', 'target', 't_above_mic', 'auc_mic', 'cmax_mic', 'pd_index'),
 'exposure_report_one_drug': ('cmax', 'tmax', 'clast', 'auc', 't_above_mic', 'auc_mic', 'cmax_mic', 'pd_index'),
 'exposure_stream': ('t', 'amount'),
 'find_guides': ('gc', 'combined', 'hairpin'),
 'find_orfs': ('gc',),
 'gc_content': ('gc',),
 'guide_candidates': ('gc',),
 'guide_specificity': ('combined',),
 'identify_sequences': ('identity', 'coverage'),
 'ligand_score': ('tanimoto', 'likeness', 'affinity'),
 'lookup_by_id': ('mean_score',),
 'max_reference_similarity': ('similarity',),
 'mean_propensity': ('mean_propensity', 'mean_prob'),
 'melting_temp': ('tm', 'gc', 'three_prime'),
 'mispriming_hits': ('match_percent',),
 'nca_metrics': ('cmax', 'tmax', 'clast', 'auc'),
 'nearest_ligands': ('tanimoto',),
 'nearest_pair': ('d',),
 'outbreak_pairs': ('d', 'identity', 'years'),
 'outbreak_report': ('rate', 'tmrca', 'closest_d', 'closest_identity', 'closest_years', 'tree_depth'),
 'own_superposition': ('t', 'conc'),
 'pair_distances': ('k2p', 'p_distance', 'identity'),
 'panel_to_rows': ('value',),
 'pd_index': ('auc_mic', 'cmax_mic', 't_above_mic'),
 'pk_profile_join': ('mic', 'dose'),
 'plasmid_annotation': ('gc',),
 'plate_cutoffs': ('cutoff_2sd', 'cutoff_3sd', 'cutoff'),
 'plate_report': ('mean_neg', 'sd_neg', 'cv_percent', 'cutoff_2sd', 'cutoff_3sd', 'cutoff', 'sensitivity', 'specificity', 'auc'),
 'plate_stats': ('mean_neg', 'sd_neg', 'cv_percent'),
 'plate_stream': ('mean_neg', 'sd_neg'),
 'predict_b_epitopes': ('hydro', 'flex', 'surf', 'turn'),
 'preferred_codon': ('fraction',),
 'primer_candidates': ('tm', 'gc', 'hairpin', 'self_dimer', 'three_prime'),
 'protein_distances': ('p_distance', 'identity'),
 'protein_tree_neighbor_joining': ('max_depth',),
 'protein_tree_upgma': ('max_depth',),
 'q_criterion': ('q',),
 'read_hit_xml': ('identity', 'coverage', 'evalue', 'bit_score'),
 'read_pdb_confidence': ('plddt',),
 'read_readings': ('total',),
 'residue_propensity': ('prob', 'surprise', 'propensity', 'confidence'),
 'reverse_translate': ('kda',),
 'roc_auc': ('auc',),
 'roc_document_quality': ('auc',),
 'roc_points': ('cutoff', 'tpr', 'fpr'),
 'runs_above': ('mean_composite', 'hydro', 'flex', 'surf', 'turn'),
 'scale_join': ('hydro', 'flex', 'surf', 'turn'),
 'score_variants': ('wt_prob', 'mut_prob', 'delta'),
 'seed_search': ('identity', 'coverage'),
 'sequence_summary': ('antigenicity',),
 'sliding_score': ('hydro', 'flex', 'surf', 'turn'),
 'similar_ligands': ('tanimoto',),
 'source_distances': ('closest', 'farthest', 'mean_d'),
 'steady_state': ('half_life', 'clearance', 'css_avg', 'css_max', 'css_min'),
 'tanimoto_join': ('tanimoto',),
 'tanimoto_pairs': ('tanimoto',),
 'tmrca': ('tmrca',),
 'top_label': ('score',),
 'top_mispriming_hits': ('match_percent',),
 'top_residues': ('propensity',),
 'trapezoid': ('auc',),
 'tree_depths': ('depth',),
 'tree_first_merge': ('height',),
 'validate_diagnosis': ('probability',),
 'validate_drug_analysis': ('confidence',),
 'variant_summary': ('mean_delta',),
 'virtual_screening': ('shape', 'electrostatic', 'hydrophobic', 'hbond', 'tpsa_score', 'binding_affinity')}
