"""pagewarden.functions"""
